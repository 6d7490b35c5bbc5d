"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

#: Words and white space as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

WARC_REVISITS = r"""
WITH u AS (
  SELECT *, coalesce(page_id, 0) AS number, (coalesce(page_id, 0) * 37) % 2000 AS hour,
         substr(md5(coalesce(html, '')), 1, 12) AS tag,
         regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://', '') AS bare
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\d*\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p:
           p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid|sid|phpsessid)(=|$)'))), '&') AS args
  FROM u
), p AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN args <> '' THEN '?' || args ELSE '' END END AS canonical_url
  FROM c
), response AS (
  SELECT '<urn:' || page_id || '>' AS record_id, canonical_url, hour,
         CASE WHEN number % 5 <> 0 THEN '"' || tag || '"' END AS etag,
         strftime(make_timestamp((1700000000 + (hour - 50) * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified,
         strlen(coalesce(html, '')) AS size
  FROM p WHERE number % 29 <> 0
), revisit AS (
  SELECT '<urn:' || page_id || '-v' || k || '>' AS record_id, canonical_url, k,
         hour + (number * 13 + k * 7) % 60 - 10 AS later,
         CASE WHEN number % 11 <> k THEN 'W/"' || CASE WHEN number % 7 = k THEN 'x' ELSE tag END || '"' END AS etag
  FROM p, (VALUES (1), (2)) AS v(k)
), found AS (
  SELECT v.record_id, v.canonical_url, v.k, v.later, v.etag,
         max(struct_pack(h := r.hour, id := r.record_id, etag := r.etag, modified := r.modified, size := r.size)) AS r
  FROM revisit v LEFT JOIN response r ON r.canonical_url = v.canonical_url AND r.hour <= v.later
  GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN r.id IS NULL THEN 'missing'
                 WHEN r.etag IS NOT NULL AND etag IS NOT NULL
                   THEN CASE WHEN r.etag = regexp_replace(etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unchecked' END AS outcome,
         make_timestamp((1700000000 + later * 3600) * 1000000) AS pos
  FROM found
)
SELECT record_id, canonical_url, strftime(pos, '%Y-%m-%d %H:%M:%S') AS warc_date, outcome, r.id AS response_id,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN
         'cache-control: max-age=' || (60 + k) || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html'
         || chr(10) || 'date: ' || strftime(pos, '%Y-%m-%dT%H:%M:%SZ')
         || coalesce(chr(10) || 'etag: ' || coalesce(etag, r.etag), '')
         || chr(10) || 'last-modified: ' || r.modified END AS headers
FROM judged
"""

MIX_SOURCES = rf"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most FROM s GROUP BY source
), r AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM src
), whole AS (
  SELECT sum(source_size)::DOUBLE AS goal, sum(weight)::DOUBLE AS weights FROM r
), l AS (
  SELECT *, sum(most) OVER w AS most_upto, sum(weight) OVER w AS weight_upto
  FROM r WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), per AS (
  SELECT l.*, (goal - (most_upto - most)::DOUBLE) / (weights - (weight_upto - weight)::DOUBLE) AS each FROM l, whole
), level AS (
  SELECT min_by(each, most / weight) AS level FROM per WHERE most / weight > each
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, level * weight) END AS target
  FROM r, level
), b AS (
  SELECT *, coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM t
), d AS (
  SELECT s.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY s.source, key) AS own
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source, source_size, target,
       (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - own < rest THEN floor(size * (rest - upto + own) / own) ELSE 0 END)::BIGINT AS taken
FROM d
"""

WINNOW_LINES = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), tidy AS (
  SELECT *, trim(regexp_replace(line, '{GAP}', ' ', 'g')) AS t FROM raw
), lines AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i,
         ('0x' || substr(md5(t), 1, 15))::BIGINT AS h, length(t) - length(replace(t, ' ', '')) + 1 AS words
  FROM tidy WHERE t <> ''
), following AS (
  SELECT *, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2, lead(words, 1) OVER w AS words1
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), marks AS (
  SELECT doc_id, i, 1 AS size, h, NULL AS h1, NULL AS h2 FROM following WHERE words >= 50
  UNION ALL SELECT doc_id, i, 2, h, h1, NULL FROM following WHERE words + words1 >= 50
  UNION ALL SELECT doc_id, i, 3, h, h1, h2 FROM following WHERE h2 IS NOT NULL
), repeated AS (
  SELECT doc_id, i, size FROM marks QUALIFY row_number() OVER (PARTITION BY size, h, h1, h2 ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM repeated r JOIN lines l ON l.doc_id = r.doc_id AND l.i BETWEEN r.i AND r.i + r.size - 1
), per AS (
  SELECT raw.doc_id, count(gone.pos) AS n_deleted,
         coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY raw.pos), '') AS text
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.pos = raw.pos GROUP BY raw.doc_id
)
SELECT doc_id, (SELECT count(*) FROM lines WHERE lines.doc_id = per.doc_id) AS n_lines, n_deleted, sha256(text) AS text_sha256 FROM per
"""

EXACT_DEDUP = rf"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{GAP}', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

HOST_RULES = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT *, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i, CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, w1, w2, w3) END AS n FROM g
), covered AS (
  SELECT doc_id, greatest(n, lag(n, 1, 0) OVER o, lag(n, 2, 0) OVER o) > 1 AS c FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id
), m AS (
  SELECT d.doc_id, host, len(words) AS n_words, length(regexp_replace(text, '{GAP}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS own_failed
  FROM m
), h AS (
  SELECT host, count(*) AS docs, count(*) FILTER (base_failed OR own_failed) AS failures FROM f GROUP BY host
), a AS (
  SELECT sum(failures) / sum(docs) AS mean, var_samp(failures / docs) AS spread, avg(1 / docs) AS noise FROM h
), b AS (
  SELECT mean, coalesce(spread, 0) - mean * (1 - mean) * noise AS between_hosts FROM a
), p AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1000.0 END AS weight FROM b
), v AS (
  SELECT host, (failures + weight * mean) / (docs + weight) AS host_rate FROM h, p
)
SELECT doc_id, f.host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       round(host_rate, 6) AS host_rate, host_rate > 0.5 AS host_rejected,
       NOT base_failed AND NOT own_failed AND host_rate <= 0.5 AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

#: CRC-32 of the bytes whose hex text is {hex}.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hex}, '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""

#: A leaf of the manifest; {text} is the text or the tampered text.
MERKLE_LEAF = """sha256(array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, {text}],
         lambda v: coalesce(strlen(v) || ':' || v, '-')), ''))"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {MERKLE_LEAF.format(text="text")} AS leaf, {MERKLE_LEAF.format(text="replace(text, chr(10), '')")} AS changed,
         coalesce({CRC32.format(hex="hex(doc_id::VARCHAR)")} % 2 = 0, false) AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER w - 1 AS pos FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
), up AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3
), low_steps AS (
  SELECT l.source, l.pos, u.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < l.pos // (3 ** u.level)::BIGINT), '') AS lefts,
         coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > l.pos // (3 ** u.level)::BIGINT), '') AS rights
  FROM leaves l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.n > 1 AND u.pos // 3 = l.pos // (3 ** (u.level + 1))::BIGINT
  GROUP BY l.source, l.pos, u.level
), top_steps AS (
  SELECT s.source, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (3 ** t.level)::BIGINT), '') AS lefts,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (3 ** t.level)::BIGINT), '') AS rights
  FROM subroots s JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // (3 ** (t.level + 1))::BIGINT
  GROUP BY s.source, t.level
), steps AS (
  SELECT source, pos, level, lefts, rights FROM low_steps
  UNION ALL
  SELECT l.source, l.pos, 1000 + t.level, t.lefts, t.rights FROM leaves l JOIN top_steps t ON t.source IS NOT DISTINCT FROM l.source
), paths AS (
  SELECT source, pos, list(lefts ORDER BY level) AS lefts, list(rights ORDER BY level) AS rights FROM steps GROUP BY source, pos
), whole AS (
  SELECT l.doc_id, l.leaf, CASE WHEN l.tampered THEN l.changed ELSE l.leaf END AS shown, s.subroot, (SELECT h FROM top WHERE n = 1) AS root,
         coalesce(p.lefts, []) AS lefts, coalesce(p.rights, []) AS rights
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
), folding AS (
  SELECT *, 0 AS done, shown AS cur FROM whole
  UNION ALL
  SELECT * EXCLUDE (done, cur), done + 1, sha256(lefts[done + 1] || cur || rights[done + 1]) FROM folding WHERE done < len(lefts)
)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), '')) AS proof_sha256,
       cur AS folded_root, cur = root AS verified
FROM folding WHERE done = len(lefts)
"""

#: One heap step per group, for as many groups as one heap of the operator takes.
LPT_SHARDS = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents
), g AS (
  SELECT text, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY sum(size) DESC, min(doc_id), sha256(text)) AS i FROM d GROUP BY text
), heap AS (
  SELECT 0::BIGINT AS i, -1 AS shard, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT g.i, list_position(loads, list_min(loads)) - 1,
         list_transform(loads, lambda l, k: l + CASE WHEN k = list_position(loads, list_min(loads)) THEN g.size ELSE 0 END)
  FROM heap JOIN g ON g.i = heap.i + 1
)
SELECT doc_id, d.size, {CRC32.format(hex="hex(d.text)")} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, sha256(d.text)) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN g USING (text) JOIN heap USING (i)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": WARC_REVISITS,
        "op2_mix_sources": MIX_SOURCES,
        "op6_winnow_lines": WINNOW_LINES,
        "op7_exact_dedup": EXACT_DEDUP,
        "op8_host_rules": HOST_RULES,
        "op11_merkle_manifest": MERKLE_MANIFEST,
        "op13_lpt_shards": LPT_SHARDS,
    }
