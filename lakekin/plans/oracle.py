"""The registered queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from lakekin.plans.lake_views import CELL_VIEWS, LAKE_IDS, VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
EPS = "1e-9 * greatest(1.0, abs(mu))"
PAIR = "table_id, key_col, value_col"
NAMES = {name: name for name in TABLES}
QUERY_TABLE = "cust_order_totals"


def _views(ids) -> str:
    return ", ".join(f"v_{i} AS ({VIEWS[i][0].format(**NAMES)})" for i in ids)


def _means(ids) -> str:
    """CTEs of the views and ``means`` with one row per pair and key."""
    parts = []
    for i in ids:
        _, keys, measures = VIEWS[i]
        for k in keys:
            for m in measures:
                parts.append(
                    f"SELECT '{i}' AS table_id, '{k}' AS key_col, '{m}' AS value_col, "
                    f"{k} AS key, avg(CAST({m} AS DOUBLE)) AS value FROM v_{i} "
                    f"WHERE {k} IS NOT NULL GROUP BY {k} HAVING count({m}) > 0"
                )
    return f"{_views(ids)}, means AS ({' UNION ALL '.join(parts)})"


def _sketch(source: str, name: str, size: int, order: str = "md5(key)", where: str = "TRUE") -> str:
    return (
        f"{name} AS (SELECT *, avg(value) OVER (PARTITION BY {PAIR}) AS mu FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY {order}, key) AS rn "
        f"FROM {source} WHERE {where}) WHERE rn <= {size})"
    )


def _sign(distance: str = "value - mu") -> str:
    return f"CASE WHEN {distance} > {EPS} THEN '+1' ELSE '-1' END"


def _index(size: int, name: str = "terms", source: str = "means", where: str = "TRUE") -> str:
    return (
        f"{_sketch(source, name + '_sketch', size, where=where)}, "
        f"{name} AS (SELECT md5(concat(key, {_sign()})) AS term, {PAIR} FROM {name}_sketch)"
    )


def _probe(size: int, where: str, name: str = "probe") -> str:
    """Distinct (term, side) of the query pairs selected by ``where``."""
    return (
        f"{_sketch('means', name + '_sketch', size, where=where)}, {name} AS ("
        f"SELECT md5(concat(key, {_sign()})) AS term, '+' AS side FROM {name}_sketch UNION "
        f"SELECT md5(concat(key, {_sign('mu - value')})) AS term, '-' AS side FROM {name}_sketch)"
    )


IS_QUERY = f"table_id = '{QUERY_TABLE}' AND value_col = 'order_total'"
COUNTS = (
    f"counts AS (SELECT {PAIR}, side, CAST(count(*) AS BIGINT) AS n "
    "FROM terms JOIN probe USING (term) GROUP BY ALL)"
)
SIGNED = (
    f"SELECT concat(table_id, '__', key_col, '_', value_col, "
    "CASE WHEN side = '+' THEN '-QPlus' ELSE '-QMinus' END) AS id, "
    f"{PAIR}, side, n AS count FROM counts"
)
LAKE = _means(LAKE_IDS)
FULL = f"WITH {LAKE}, {_index(128)}"
SEARCH = f"{FULL}, {_probe(128, IS_QUERY)}, {COUNTS}"

EXACT = f"""q AS (SELECT key, value AS x FROM means WHERE {IS_QUERY}),
exact AS (SELECT {PAIR}, CAST(count(*) AS BIGINT) AS n,
  count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM q) AS joinability,
  CASE WHEN count(*) < 2 OR var_samp(value) <= 1e-10 THEN 0.0
       ELSE covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) END AS correlation
  FROM means JOIN q USING (key) GROUP BY ALL)"""


def _exact_top(k: int, weight: float = 0.5) -> str:
    return (
        f"SELECT *, pow(joinability, {1 - weight}) * pow(abs(correlation), {weight}) AS score "
        f"FROM exact ORDER BY round(score, 9) DESC NULLS LAST, {PAIR} LIMIT {k}"
    )


def _cells() -> str:
    parts = []
    for name, (view, columns) in CELL_VIEWS.items():
        for position, (column, is_text) in enumerate(columns):
            number = f"TRY_CAST({column} AS DOUBLE)" if is_text else f"CAST({column} AS DOUBLE)"
            parts.append(
                f"SELECT '{name}' AS table_id, row_id, CAST({position} AS INTEGER) AS column_id, "
                f"'{column}' AS column_name, CAST({column} AS VARCHAR) AS cell, {number} AS num "
                f"FROM c_{name}"
            )
    views = ", ".join(f"c_{n} AS ({v.format(**NAMES)})" for n, (v, _) in CELL_VIEWS.items())
    return f"{views}, cells AS ({' UNION ALL '.join(parts)})"


CELLS = _cells()
PROFILE = """profile AS (SELECT table_id, column_id, max(column_name) AS column_name,
  CAST(count(*) AS BIGINT) AS n_cells, CAST(count(num) AS BIGINT) AS n_numbers,
  CAST(count(*) FILTER (WHERE cell IS NULL) AS BIGINT) AS n_missing FROM cells GROUP BY table_id, column_id)"""
STRICT = (
    "roles AS (SELECT *, CASE WHEN n_numbers + n_missing = n_cells THEN 'measure' "
    "WHEN n_numbers + n_missing = 0 THEN 'key' END AS role FROM profile)"
)
DTYPE = (
    "roles AS (SELECT *, CASE WHEN n_cells - n_numbers - n_missing > 0 THEN 'key' "
    "WHEN n_numbers > 0 THEN 'measure' END AS role FROM profile)"
)
CELL_MEANS = f"""WITH {CELLS}, {PROFILE}, {{roles}},
big AS (SELECT table_id FROM cells GROUP BY table_id HAVING count(DISTINCT row_id) >= 12),
means AS (SELECT k.table_id, rk.column_name AS key_col, rv.column_name AS value_col,
  k.cell AS key, avg(v.num) AS value
  FROM cells k JOIN cells v ON k.table_id = v.table_id AND k.row_id = v.row_id
  JOIN roles rk ON rk.table_id = k.table_id AND rk.column_id = k.column_id AND rk.role = 'key'
  JOIN roles rv ON rv.table_id = v.table_id AND rv.column_id = v.column_id AND rv.role = 'measure'
  JOIN big ON big.table_id = k.table_id
  WHERE k.cell IS NOT NULL AND v.num IS NOT NULL GROUP BY ALL)"""

SIGNED_TOP = f"{SIGNED} ORDER BY n DESC, id LIMIT 10"
def _model_grid() -> str:
    """Least squares by Gram-Schmidt: after k steps y is the residual of the first k features."""
    names = [f"x{i}" for i in range(7)]
    of = "OVER (PARTITION BY rows)"
    train = f"FILTER (WHERE is_train) {of}"
    steps, results = [], []
    for skip in (0, 1):
        order = ["x0", *names[1 + skip : 6 + skip]]
        before = "centred"
        for k, x in enumerate(order):
            later = [*order[k + 1 :], "y"]
            slopes = ", ".join(
                f"CASE WHEN sum({x} * {x}) {train} > 1e-9 * own_{x} THEN sum({x} * {v}) {train} / sum({x} * {x}) {train} ELSE 0 END AS b_{v}"
                for v in later
            )
            changed = ", ".join(f"{v} - b_{v} * {x} AS {v}" for v in later)
            steps.append(f"s{skip}{k} AS MATERIALIZED (SELECT * REPLACE ({changed}) FROM (SELECT * REPLACE ({slopes}) FROM {before}))")
            results.append(f"SELECT rows, 'added_{k}_skip_{skip}' AS config, label AS y, label - y AS p FROM s{skip}{k} WHERE NOT is_train")
            before = f"s{skip}{k}"
    wide = ", ".join(f"max(CASE WHEN place = {p} THEN value END) AS x{p}" for p in range(1, 7))
    mean = ", ".join(f"coalesce({x} - avg({x}) {train}, 0) AS {x}" for x in names)
    own = ", ".join(f"sum({x} * {x}) {train} AS own_{x}" for x in names)
    slope = ", ".join(f"CAST(0 AS DOUBLE) AS b_{v}" for v in ["y", *names])
    return f"""{SEARCH}, {HITS}, base AS (SELECT c_name, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) / 1e7 AS y,
  CAST(c_acctbal AS DOUBLE) AS x0 FROM orders JOIN customer ON o_custkey = c_custkey),
both_rows AS (SELECT 'each' AS rows, * FROM base UNION ALL SELECT 'grouped', c_name, avg(y), avg(x0) FROM base GROUP BY c_name),
wide AS (SELECT key, {wide} FROM means JOIN hits USING ({PAIR}) GROUP BY key),
joined AS (SELECT both_rows.*, wide.* EXCLUDE (key), substring(md5(concat('7:', c_name)), 1, 8) < 'e6666666' AS is_train
  FROM both_rows LEFT JOIN wide ON key = c_name),
near AS (SELECT rows, is_train, y AS label, y - avg(y) {train} AS y, {mean} FROM joined),
centred AS MATERIALIZED (SELECT *, {own}, {slope} FROM near), {", ".join(steps)},
predictions AS ({" UNION ALL ".join(results)})
SELECT rows, config, {METRICS.replace("GROUP BY config", "GROUP BY rows, config")}"""


HITS = f"""top AS (SELECT * FROM ({SIGNED} WHERE table_id <> '{QUERY_TABLE}' ORDER BY n DESC, id LIMIT 10)),
hits AS (SELECT {PAIR}, row_number() OVER (ORDER BY max(count) DESC, {PAIR}) AS place FROM top GROUP BY {PAIR})"""

# Blocks of customers that stand for the files of a lake (see queries.py).
BLOCKS = """blocks AS (SELECT c_custkey, c_name, c_mktsegment, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS acctbal,
  c_custkey // {size} AS block,
  row_number() OVER (PARTITION BY c_custkey // {size} ORDER BY c_custkey) - 1 AS pos FROM customer)"""
BLOCK_CELLS = """SELECT {table_id} AS table_id, CAST(pos AS BIGINT) AS row_id, CAST(0 AS INTEGER) AS column_id,
  'c_name' AS column_name, c_name AS cell, CAST(NULL AS DOUBLE) AS num FROM blocks
UNION ALL SELECT {table_id}, pos, 1, 'c_mktsegment', c_mktsegment, NULL FROM blocks
UNION ALL SELECT {table_id}, pos, 2, 'acctbal', CAST(acctbal AS VARCHAR), CAST(acctbal AS DOUBLE) FROM blocks"""

PREDICTIONS = """base AS (SELECT c_custkey, c_name, c_mktsegment, n_name, CAST(order_total AS DOUBLE) AS y
  FROM v_cust_order_totals JOIN (SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey) USING (c_name)),
predictions AS (
  SELECT 'by_segment' AS config, y / 1e8 AS y, avg(y) OVER (PARTITION BY c_mktsegment) / 1e8 AS p FROM base
  UNION ALL SELECT 'by_nation', y / 1e8, avg(y) OVER (PARTITION BY n_name) / 1e8 FROM base
  UNION ALL SELECT 'overall', y / 1e8, avg(y) OVER () / 1e8 FROM base)"""

LE_BYTES = ", ".join(f"substring(md5(key), {i}, 2)" for i in range(29, 0, -2))
LE_ORDER = (
    "concat(translate(substring(md5(key), 31, 1), '0123456789abcdef', '89abcdef01234567'), "
    f"substring(md5(key), 32, 1), {LE_BYTES})"
)
HEX = "lpad(lower(hex({0})), CAST(greatest(32, length(hex({0}))) AS INTEGER), '0')"


def _small_terms(term: str, order: str = "md5(key)") -> str:
    return f"WITH {_means(LAKE_IDS)}, {_sketch('means', 's', 128, order)} SELECT {term} AS term, {PAIR} FROM s"


def _grid_sql(k: int) -> str:
    sizes = (512, 128, 32)
    ctes, unions = [], []
    for n in sizes:
        ctes.append(_index(n, f"t{n}"))
        ctes.append(_probe(n, IS_QUERY, f"p{n}"))
    for i in sizes:
        for j in sizes:
            unions.append(
                f"SELECT {i} AS index_size, {j} AS query_size, {PAIR}, side, count(*) AS n "
                f"FROM t{i} JOIN p{j} USING (term) GROUP BY ALL"
            )
    return (
        f"WITH {LAKE}, {', '.join(ctes)}, {EXACT}, truth AS (SELECT {PAIR} FROM ({_exact_top(k)})), "
        f"grid AS ({' UNION ALL '.join(unions)}), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY index_size, query_size "
        f"ORDER BY n DESC, {PAIR}, side) AS place FROM grid), "
        f"found AS (SELECT DISTINCT index_size, query_size, {PAIR} FROM ranked WHERE place <= {k}), "
        f"c AS (SELECT CAST(index_size AS INTEGER) AS index_size, CAST(query_size AS INTEGER) AS query_size, "
        f"CAST(count(*) AS BIGINT) AS n_found, CAST(count(t.table_id) AS BIGINT) AS n_common, "
        f"(SELECT count(*) FROM truth) AS n_truth FROM found f LEFT JOIN truth t USING ({PAIR}) GROUP BY ALL) "
        f"SELECT *, round(n_common / n_found, 6) AS precision, round(n_common / n_truth, 6) AS recall, "
        f"round(2.0 * n_common / (n_found + n_truth), 6) AS f1 FROM c"
    )


def _p_value(r: str, n: str) -> str:
    """Two-sided p of a correlation, by the finite series for whole degrees of freedom."""
    rest = f"ln(1 - {r} * {r})"
    even = f"list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) + k * {rest}) / sqrt(pi()) for k in range(0, ({n} - 2) // 2)])"
    odd = f"list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * {rest}) * sqrt(pi()) / 2 for k in range(0, ({n} - 3) // 2)])"
    return (
        f"CASE WHEN {n} <= 2 OR {r} IS NULL THEN NULL WHEN abs({r}) >= 1 - 1e-15 THEN 0.0 "
        f"WHEN {n} % 2 = 0 THEN 1 - abs({r}) * {even} "
        f"ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce({odd}, 0)) END"
    )


def _lines(final: str) -> str:
    """Model checks: least squares on two features, by the normal equations."""
    views = _views(("cust_order_totals", "cust_item_totals"))
    return f"""WITH {views}, all_rows AS (SELECT c_custkey, CAST(n_orders AS DOUBLE) AS n_orders,
  CAST(n_items AS DOUBLE) AS n_items, order_total / 1e8 AS y,
  substring(md5(concat('7:', CAST(c_custkey AS VARCHAR))), 1, 8) < 'e6666666' AS is_train
  FROM v_cust_order_totals JOIN v_cust_item_totals USING (c_name) JOIN customer USING (c_name)),
moments AS (SELECT var_pop(n_orders) AS s11, var_pop(n_items) AS s22, covar_pop(n_orders, n_items) AS s12,
  covar_pop(y, n_orders) AS s1y, covar_pop(y, n_items) AS s2y, avg(n_orders) AS m1, avg(n_items) AS m2, avg(y) AS my
  FROM all_rows WHERE is_train),
slopes AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
  (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, s1y / s11 AS b0 FROM moments),
fit AS (SELECT b0, b1, b2, my - b1 * m1 - b2 * m2 AS start, my - b0 * m1 AS start_one FROM slopes),
test AS (SELECT * FROM all_rows WHERE NOT is_train),
grid AS (SELECT DISTINCT unnest(quantile_disc(n_items, [0.0, 0.25, 0.5, 0.75, 1.0])) AS grid_x FROM test),
{final}"""


def _line(orders: str, items: str) -> str:
    return f"(start + b1 * {orders} + b2 * {items})"


METRICS = (
    "CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, "
    "round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, "
    "round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, "
    "round(covar_samp(y, p) / nullif(stddev_samp(y) * stddev_samp(p), 0), 6) AS pearson, "
    "round(median(abs(y - p)), 6) AS median_ae FROM predictions GROUP BY config"
)
ICE = f"ice AS (SELECT c_custkey AS instance_id, grid_x, {_line('n_orders', 'grid_x')} AS p FROM test, grid, fit)"
IMPORTANCE = f"""base AS (SELECT *, CAST(c_custkey AS VARCHAR) AS row_key FROM test),
placed AS (SELECT base.*, feature, round,
  md5(concat(row_key, ':', feature, ':', CAST(round AS VARCHAR), ':0')) AS place
  FROM base, (SELECT unnest(['n_orders', 'n_items']) AS feature), (SELECT unnest(range(1, 21)) AS round)),
grouped AS (SELECT *, CAST(concat('0x', substring(place, 1, 8)) AS BIGINT)
  % greatest(1, CAST(ceil((SELECT count(*) FROM test) / 4096.0) AS BIGINT)) AS grp,
  CASE WHEN feature = 'n_orders' THEN n_orders ELSE n_items END AS own FROM placed),
donors AS (SELECT *, coalesce(lead(own) OVER line, first_value(own) OVER line) AS donated FROM grouped
  WINDOW line AS (PARTITION BY feature, round, grp ORDER BY place, row_key)),
scored AS (SELECT feature, round, y - ({_line(
    "CASE WHEN feature = 'n_orders' THEN donated ELSE n_orders END",
    "CASE WHEN feature = 'n_items' THEN donated ELSE n_items END",
)}) AS e FROM donors, fit),
plain AS (SELECT sqrt(avg(pow(y - ({_line('n_orders', 'n_items')}), 2))) AS rmse FROM test, fit),
drops AS (SELECT feature, round, sqrt(avg(e * e)) - (SELECT rmse FROM plain) AS d FROM scored GROUP BY ALL)"""
# Fixed value: the 0.995 quantile of Student's t with 19 degrees of freedom.
T_995_19 = 2.860934606449914


#: Every pair of the two tables with several key columns and measures.
MULTI_QUERY = "table_id IN ('customer', 'part')"


def oracle_sql() -> dict[str, str]:
    totals = VIEWS["cust_order_totals"][0].format(**NAMES)
    csv_blocks = BLOCKS.format(size=50)
    csv_table = "concat('cust_', lpad(CAST(block AS VARCHAR), 8, '0'))"
    web_blocks = BLOCKS.format(size=20)
    split_hash = "md5(concat('7:', CAST(c_custkey AS VARCHAR)))"
    row_stats = f"""WITH {_views(LAKE_IDS)}, q AS (SELECT c_name AS key, CAST(order_total AS DOUBLE) AS x FROM v_{QUERY_TABLE}),
shared AS ({' UNION ALL '.join(
        f"SELECT '{i}' AS table_id, '{k}' AS key_col, {p} AS position, count(DISTINCT {k}) AS overlap "
        f"FROM v_{i} WHERE {k} IN (SELECT key FROM q) HAVING count(*) > 0"
        for i in LAKE_IDS for p, k in enumerate(VIEWS[i][1]))})"""
    joined = " UNION ALL ".join(
        f"SELECT '{i}' AS table_id, '{k}' AS key_col, '{m}' AS value_col, count(*) AS n, "
        f"covar_samp(x, CAST({m} AS DOUBLE)) / nullif(stddev_samp(x) * stddev_samp(CAST({m} AS DOUBLE)), 0) AS r "
        f"FROM v_{i} JOIN q ON {k} = key HAVING count(*) > 0"
        for i in LAKE_IDS
        for k in VIEWS[i][1]
        for m in VIEWS[i][2]
    )
    sql = {
        # sources, profiles
        "lake_cells": f"WITH {CELLS} SELECT * FROM cells",
        "clean_keys": f"WITH {CELLS} SELECT table_id, row_id, column_id, column_name, "
        "CASE WHEN num IS NULL THEN lower(trim(cell)) ELSE cell END AS cell, num FROM cells",
        "csv_lake_cells": f"WITH {csv_blocks} {BLOCK_CELLS.format(table_id=csv_table)}",
        "archive_tables": f"WITH {csv_blocks} {BLOCK_CELLS.format(table_id=csv_table.replace('cust_', 'customers_part_'))}",
        "relation_cells": f"WITH {web_blocks} "
        + BLOCK_CELLS.format(table_id="concat('dwtc-007_', CAST(block AS VARCHAR))"),
        "column_profile": f"WITH {CELLS}, {PROFILE}, {STRICT} SELECT * FROM roles",
        "column_profile_dtype": f"WITH {CELLS}, {PROFILE}, {DTYPE} SELECT * FROM roles",
        "column_pairs": f"WITH {CELLS}, {PROFILE}, {STRICT} SELECT k.table_id, k.column_name AS key_col, "
        "v.column_name AS value_col FROM roles k JOIN roles v USING (table_id) "
        "WHERE k.role = 'key' AND v.role = 'measure' AND k.n_cells >= 12",
        "table_stats": f"WITH {CELLS} SELECT table_id, CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows, "
        "CAST(count(DISTINCT column_id) AS BIGINT) AS n_columns FROM cells GROUP BY table_id",
        "map_tables": f"WITH {CELLS} SELECT table_id, CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows, "
        "CAST(count(DISTINCT column_id) AS BIGINT) AS n_columns FROM cells GROUP BY table_id",
        "rebuild_table": "SELECT c_custkey AS row_id, c_name AS \"0\", c_mktsegment AS \"1\", "
        "CAST(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS VARCHAR) AS \"2\" FROM customer",
        # sketches and index
        "pair_means": f"WITH {LAKE} SELECT {PAIR}, key, round(value, 6) AS value FROM means",
        "cell_pair_means_strict": CELL_MEANS.format(roles=STRICT)
        + f" SELECT {PAIR}, key, round(value, 6) AS value FROM means",
        "cell_pair_means_dtype": CELL_MEANS.format(roles=DTYPE)
        + f" SELECT {PAIR}, key, round(value, 6) AS value FROM means",
        "cell_term_index": CELL_MEANS.format(roles=STRICT)
        + f", {_index(128)} SELECT term, {PAIR} FROM terms",
        "pair_sketch": f"WITH {LAKE}, {_sketch('means', 's', 128)} SELECT {PAIR}, key, "
        "round(value, 6) AS value, md5(key) AS key_hash, CAST(rn AS INTEGER) AS sketch_rank FROM s",
        "pair_sketch_sha2": f"WITH {_means(LAKE_IDS)}, {_sketch('means', 's', 128, 'sha256(key)')} "
        f"SELECT {PAIR}, key, CAST(rn AS INTEGER) AS sketch_rank FROM s",
        "pair_sketch_le_signed": f"WITH {_means(LAKE_IDS)}, {_sketch('means', 's', 128, LE_ORDER)} "
        f"SELECT {PAIR}, key, CAST(rn AS INTEGER) AS sketch_rank FROM s",
        "term_index": f"{FULL} SELECT term, {PAIR} FROM terms",
        "term_index_hex": _small_terms(HEX.format(f"concat(key, {_sign()})")),
        "term_index_inner": _small_terms(f"md5(concat(md5(key), {_sign()}))"),
        "term_index_sql_label": _small_terms(f"md5(concat(key, {_sign('mu - value')}))"),
        "index_append": f"{FULL} SELECT term, {PAIR} FROM terms",
        "index_store": f"{FULL} SELECT term, {PAIR} FROM terms",
        "index_stats": f"{FULL} SELECT {PAIR}, CAST(count(DISTINCT term) AS BIGINT) AS n_terms, "
        "round(avg(CAST(concat('0x', substring(term, 1, 7)) AS BIGINT)), 4) AS mean_prefix "
        "FROM terms GROUP BY ALL",
        "inverted_lists": f"{FULL} SELECT term, CAST(count(*) AS BIGINT) AS n_pairs FROM terms GROUP BY term",
        "index_stream": f"WITH {csv_blocks}, means AS ("
        + " UNION ALL ".join(
            f"SELECT {csv_table} AS table_id, '{k}' AS key_col, 'acctbal' AS value_col, {k} AS key, "
            f"avg(CAST(acctbal AS DOUBLE)) AS value FROM blocks GROUP BY {csv_table}, {k}"
            for k in ("c_name", "c_mktsegment")
        )
        + f"), {_index(128)} SELECT term, {PAIR} FROM terms",
        # searches
        "search_signed": f"{SEARCH} {SIGNED_TOP}",
        "search_stored": f"{SEARCH} {SIGNED_TOP}",
        "search_multi_stored": f"{FULL}, {_probe(128, MULTI_QUERY)}, {COUNTS} {SIGNED_TOP}",
        "search_multi": f"{FULL}, {_probe(128, f'table_id = {chr(39)}{QUERY_TABLE}{chr(39)}')}, {COUNTS} {SIGNED_TOP}",
        "search_abs": f"{FULL}, {_probe(64, IS_QUERY)}, {COUNTS} SELECT "
        f"concat(table_id, '_|_', key_col, '_|_', value_col) AS id, {PAIR}, "
        "CASE WHEN side = '+' THEN n ELSE -n END AS qcr_score, n AS abs_qcr_score FROM counts "
        "ORDER BY abs_qcr_score DESC, id, qcr_score DESC LIMIT 10",
        "search_counter": f"{FULL}, {_probe(100, IS_QUERY)}, {COUNTS} SELECT "
        "concat(side, ':', table_id, '_|_', key_col, '_|_', value_col) AS id, n AS count FROM counts "
        "ORDER BY count DESC, id LIMIT 10",
        # exact searches and quality
        "exact_corr": f"WITH {LAKE}, {EXACT} SELECT {PAIR}, n, round(joinability, 6) AS joinability, "
        "round(correlation, 6) AS correlation FROM exact",
        "exact_topk": f"WITH {LAKE}, {EXACT} SELECT {PAIR}, n, round(joinability, 6) AS joinability, "
        f"round(correlation, 6) AS correlation, round(score, 6) AS score FROM ({_exact_top(10)})",
        "exact_topk_weighted": f"WITH {LAKE}, {EXACT} SELECT {PAIR}, n, round(joinability, 6) AS joinability, "
        f"round(correlation, 6) AS correlation, round(score, 6) AS score FROM ({_exact_top(5, 0.75)})",
        "overlap_topk": f"{row_stats} SELECT table_id, key_col, CAST(overlap AS BIGINT) AS overlap "
        "FROM shared ORDER BY overlap DESC, table_id, key_col LIMIT 20",
        "overlap_rank_corr": f"{row_stats}, best AS (SELECT * FROM shared ORDER BY overlap DESC, "
        f"table_id, key_col LIMIT 20), joined AS ({joined}) SELECT {PAIR}, CAST(overlap AS BIGINT) AS overlap, "
        "CAST(n AS BIGINT) AS joinability, round(r, 6) AS correlation FROM joined JOIN best USING (table_id, key_col)",
        "containment_best": f"WITH {LAKE}, q AS (SELECT key, value AS x FROM means WHERE {IS_QUERY}), "
        "shares AS (SELECT table_id, key_col, count(DISTINCT key) / (SELECT CAST(count(*) AS DOUBLE) FROM q) AS containment "
        "FROM means WHERE key IN (SELECT key FROM q) GROUP BY ALL), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY containment DESC, key_col) AS rn FROM shares) "
        f"SELECT {PAIR}, round(c, 6) AS containment, n, round(r, 6) AS correlation, round({_p_value('r', 'n')}, 6) AS p_value "
        f"FROM (SELECT {PAIR}, max(containment) AS c, CAST(count(*) AS BIGINT) AS n, "
        "covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) AS r "
        "FROM means JOIN best USING (table_id, key_col) JOIN q USING (key) "
        "WHERE rn = 1 AND containment > 0.5 GROUP BY ALL)",
        "search_quality": f"{SEARCH}, {EXACT}, truth AS (SELECT {PAIR} FROM ({_exact_top(10)})), "
        f"found AS (SELECT DISTINCT {PAIR} FROM ({SIGNED_TOP})), "
        "c AS (SELECT (SELECT count(*) FROM found) AS n_found, "
        f"(SELECT count(*) FROM found JOIN truth USING ({PAIR})) AS n_common, "
        "(SELECT count(*) FROM truth) AS n_truth) "
        "SELECT *, round(n_common / n_found, 6) AS precision, round(n_common / n_truth, 6) AS recall, "
        "round(2.0 * n_common / (n_found + n_truth), 6) AS f1 FROM c",
        "quality_grid": _grid_sql(8),
        # use of results
        "augment_mean": "SELECT c_custkey, c_name, mean_price FROM customer LEFT JOIN ("
        "SELECT c_name, avg(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS mean_price FROM orders "
        "JOIN customer ON o_custkey = c_custkey GROUP BY c_name) USING (c_name)",
        "augment_multi": f"{SEARCH}, {HITS} SELECT q.key AS c_name, q.value AS order_total, "
        + ", ".join(
            f"round(max(CASE WHEN place = {p} THEN m.value END), 6) AS hit_{p}" for p in range(1, 6)
        )
        + f" FROM (SELECT key, value FROM means WHERE {IS_QUERY}) q LEFT JOIN "
        f"(SELECT key, value, place FROM means JOIN hits USING ({PAIR})) m ON q.key = m.key GROUP BY q.key, q.value",
        "hash_split": f"SELECT c_custkey, CASE WHEN substring({split_hash}, 1, 8) < 'e6666666' "
        "THEN 'train' ELSE 'test' END AS split FROM customer",
        "exact_split": "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY "
        f"{split_hash}) <= floor(0.9 * (SELECT count(*) FROM customer)) "
        "THEN 'train' ELSE 'test' END AS split FROM customer",
        "regression_metrics": f"WITH v_cust_order_totals AS ({totals}), {PREDICTIONS} SELECT config, "
        f"{METRICS}",
    }
    half = f"{T_995_19} * stddev_samp(d) / sqrt(20)"
    # The correlation whose test statistic with 19 degrees of freedom is that of the mean.
    t = "(avg(d) / nullif(stddev_samp(d) / sqrt(20), 0))"
    tail = f"({_p_value(f'({t} / sqrt(19 + {t} * {t}))', '21')} / 2)"
    sql["perm_importance_lines"] = _lines(
        f"{IMPORTANCE} SELECT feature, round(avg(d), 6) AS importance, round(stddev_samp(d), 6) AS stddev, "
        f"CAST(count(*) AS BIGINT) AS n, round(avg(d) + {half}, 6) AS p99_high, "
        f"round(avg(d) - {half}, 6) AS p99_low, round(CASE WHEN avg(d) >= 0 THEN {tail} ELSE 1 - {tail} END, 6) AS p_value "
        "FROM drops GROUP BY feature"
    )
    sql["train_eval_lines"] = _lines(
        f"predictions AS (SELECT 'one' AS config, y, start_one + b0 * n_orders AS p FROM test, fit "
        f"UNION ALL SELECT 'both', y, {_line('n_orders', 'n_items')} FROM test, fit) SELECT config, {METRICS}"
    )
    sql["model_grid"] = _model_grid()
    sql["exact_corr_multi"] = (
        f"WITH {LAKE}, q AS (SELECT table_id AS query_table, key_col AS query_key, value_col AS query_value, "
        f"key, value AS x FROM means WHERE {MULTI_QUERY}), "
        "totals AS (SELECT query_table, query_key, query_value, CAST(count(*) AS DOUBLE) AS total FROM q GROUP BY ALL) "
        f"SELECT query_table, query_key, query_value, {PAIR}, CAST(count(*) AS BIGINT) AS n, "
        "round(count(*) / any_value(total), 6) AS joinability, "
        "round(CASE WHEN count(*) < 2 OR var_samp(value) <= 1e-10 THEN 0.0 "
        "ELSE covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) END, 6) AS correlation "
        "FROM means JOIN q USING (key) JOIN totals USING (query_table, query_key, query_value) GROUP BY ALL"
    )
    sql["ice_curves_lines"] = _lines(
        f"{ICE} SELECT instance_id, grid_x, round(p - first_value(p) OVER "
        "(PARTITION BY instance_id ORDER BY grid_x), 6) AS prediction FROM ice"
    )
    sql["pdp_curve_lines"] = _lines(
        f"{ICE} SELECT grid_x, round(avg(p), 6) AS prediction FROM ice GROUP BY grid_x"
    )
    sql["exact_corr_cells"] = CELL_MEANS.format(roles=STRICT) + f""",
q AS (SELECT source AS key, avg(CAST(n_chars AS DOUBLE)) AS x FROM documents GROUP BY source)
SELECT {PAIR}, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM q), 6) AS joinability,
  round(CASE WHEN count(*) < 2 OR var_samp(value) <= 1e-10 THEN 0.0
    ELSE covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) END, 6) AS correlation
FROM means JOIN q USING (key) GROUP BY ALL"""
    key_rows = (
        CELL_MEANS.format(roles=STRICT)
        + """,
lists AS (SELECT k.table_id, r.column_name AS key_col, k.column_id AS position, k.cell AS key, count(*) AS rows
  FROM cells k JOIN roles r ON r.table_id = k.table_id AND r.column_id = k.column_id AND r.role = 'key'
  JOIN big ON big.table_id = k.table_id
  WHERE k.cell IS NOT NULL AND k.table_id IN (SELECT table_id FROM roles WHERE role = 'measure') GROUP BY ALL)"""
    )
    sql["key_lists"] = (
        f"{key_rows} SELECT *, count(*) OVER (PARTITION BY key) AS columns FROM lists"
    )
    tall_rows = " UNION ALL ".join(
        f"SELECT '{i}' AS query_table, '{k}' AS query_key, '{m}' AS query_value, {k} AS key, CAST({m} AS DOUBLE) AS x FROM v_{i} WHERE {k} IS NOT NULL"
        for i in ("docs", "customer")
        for k in VIEWS[i][1]
        for m in VIEWS[i][2]
    )
    tall = f"""{key_rows}, {_views(("docs", "customer"))}, qrows AS ({tall_rows}),
qkeys AS (SELECT query_table, query_key, key, count(*) AS q_rows FROM qrows GROUP BY ALL),
qmeans AS (SELECT query_table, query_key, query_value, key, avg(x) AS x FROM qrows GROUP BY ALL HAVING count(x) > 0),
shared AS (SELECT query_table, query_key, table_id, key_col, position, CAST(count(*) AS BIGINT) AS overlap,
  CAST(sum(rows * q_rows) AS BIGINT) AS joinability FROM qkeys JOIN lists USING (key) GROUP BY ALL),
best AS (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY query_table, query_key ORDER BY overlap DESC, table_id, key_col) <= 2)"""
    sql["overlap_topk_cells"] = (
        f"{tall} SELECT query_table, query_key, table_id, key_col, overlap, joinability FROM best"
    )
    sql["overlap_rank_corr_cells"] = f"""{tall},
rowjoin AS (SELECT q.query_table, q.query_key, q.query_value, b.table_id, b.key_col, rv.column_name AS value_col,
  covar_samp(q.x, v.num) / nullif(stddev_samp(q.x) * stddev_samp(v.num), 0) AS r
  FROM best b JOIN roles rk ON rk.table_id = b.table_id AND rk.column_name = b.key_col
  JOIN cells k ON k.table_id = b.table_id AND k.column_id = rk.column_id
  JOIN cells v ON v.table_id = k.table_id AND v.row_id = k.row_id
  JOIN roles rv ON rv.table_id = v.table_id AND rv.column_id = v.column_id AND rv.role = 'measure'
  JOIN qrows q ON q.query_table = b.query_table AND q.query_key = b.query_key AND q.key = k.cell
  WHERE v.num IS NOT NULL AND q.x IS NOT NULL GROUP BY ALL)
SELECT b.query_table, b.query_key, m.query_value, b.table_id, b.key_col, p.column_name AS value_col, overlap, joinability, round(r, 6) AS correlation
FROM best b JOIN (SELECT DISTINCT query_table, query_key, query_value FROM qrows) m USING (query_table, query_key)
JOIN roles p ON p.table_id = b.table_id AND p.role = 'measure'
LEFT JOIN rowjoin j ON j.query_table = b.query_table AND j.query_key = b.query_key AND j.query_value = m.query_value
  AND j.table_id = b.table_id AND j.key_col = b.key_col AND j.value_col = p.column_name"""
    sql["containment_best_cells"] = f"""{tall},
shares AS (SELECT s.*, overlap / total AS containment FROM shared s
  JOIN (SELECT query_table, query_key, CAST(count(*) AS DOUBLE) AS total FROM qkeys GROUP BY ALL) USING (query_table, query_key)),
chosen AS (SELECT * FROM shares WHERE containment > 0.5
  QUALIFY row_number() OVER (PARTITION BY query_table, query_key, table_id ORDER BY containment DESC, position) = 1)
SELECT query_table, query_key, query_value, {PAIR}, round(c, 6) AS containment, n, round(r, 6) AS correlation,
  round({_p_value("r", "n")}, 6) AS p_value
FROM (SELECT query_table, query_key, query_value, {PAIR}, max(containment) AS c, CAST(count(*) AS BIGINT) AS n,
  covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) AS r
  FROM chosen JOIN qmeans USING (query_table, query_key) JOIN means USING (table_id, key_col, key) GROUP BY ALL)"""
    sql["augment_multi_cells"] = CELL_MEANS.format(roles=STRICT) + f""",
q AS (SELECT source AS key, avg(CAST(n_chars AS DOUBLE)) AS x FROM documents GROUP BY source),
found AS (SELECT {PAIR}, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM q) AS joinability,
  CASE WHEN count(*) < 2 OR var_samp(value) <= 1e-10 THEN 0.0
    ELSE covar_samp(x, value) / nullif(stddev_samp(x) * stddev_samp(value), 0) END AS r FROM means JOIN q USING (key) GROUP BY ALL),
hits AS (SELECT {PAIR}, row_number() OVER (ORDER BY round(sqrt(joinability * abs(r)), 9) DESC NULLS LAST, {PAIR}) AS place FROM found)
SELECT doc_id, source, {", ".join(f"round(max(CASE WHEN place = {p} THEN value END), 6) AS hit_{p}" for p in (2, 3, 4))}
FROM documents d LEFT JOIN (SELECT key, value, place FROM means JOIN hits USING ({PAIR}) WHERE place <= 4) m ON m.key = d.source
GROUP BY doc_id, source"""
    sql["index_merge"] = sql["cell_term_index"]
    sql["index_table_stream"] = sql["cell_term_index"]
    sql["index_merge_stream"] = (
        f"WITH {csv_blocks}, means AS ("
        + " UNION ALL ".join(
            f"SELECT 'customers' AS table_id, '{k}' AS key_col, 'acctbal' AS value_col, {k} AS key, "
            f"avg(CAST(acctbal AS DOUBLE)) AS value FROM blocks GROUP BY {k}"
            for k in ("c_name", "c_mktsegment")
        )
        + f"), {_index(128)} SELECT term, {PAIR} FROM terms"
    )
    sql["pair_sketch_two_pass"] = sql["pair_sketch"]
    return sql
