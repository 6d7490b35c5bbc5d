"""Resolving not-modified revisits of a web archive.

WARC records are parsed with DataFrame functions. A revisit that says "not modified"
(by its profile or by status 304) stands for the latest earlier full response of the
same canonical URL, if their validators agree; its headers are the stored ones with
those replaced that a 304 may renew. The as-of join orders records by (URL, date, id)
over range partitions and hands one row from each partition to the next, so a URL
with any number of captures is spread like all others.

Defined results: a record that cannot be parsed has null fields and is neither
response nor revisit; a null URL matches nothing; a response of the same second as
its revisit counts as earlier; repeated records repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.session import materialize

#: The headers of a 304 that renew stored ones.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visitor and not a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid|sid|phpsessid)(=|$)"

OUTCOMES = ("resolved", "unchecked", "mismatch", "missing")


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.``, fragment, default port or tracking.

    Host letters are lowered, query parameters sorted, a last slash dropped.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    args = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(args != "", F.concat(F.lit("?"), args)).otherwise("")))


def header_map(block: Column) -> Column:
    """Headers of a block by lower-case name; repeated ones joined by a comma."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[^\s:]+:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("v")),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Fields of WARC records given as strings; other columns unchanged.

    Only the two header blocks at the front are searched, not the body.
    """
    text, end = F.col(column), "\r\n\r\n"
    head = F.substring_index(text, end, 1)
    both = F.substring_index(text, end, 2)
    http = F.substring(both, F.length(head) + len(end) + 1, F.length(both))
    parsed = records.withColumns(
        {
            "__warc": header_map(F.when(head.startswith("WARC/"), head)),
            "__http": F.when(head.startswith("WARC/") & http.startswith("HTTP/"), http),
        }
    )
    status = F.regexp_extract("__http", r"\AHTTP/\S+ +(\d{3})", 1)
    own = F.col("__warc")
    url = F.regexp_replace(own["warc-target-uri"], "^<|>$", "")
    return parsed.select(
        *records.columns,
        own["warc-record-id"].alias("record_id"),
        own["warc-type"].alias("warc_type"),
        url.alias("target_uri"),
        canonical_url(url).alias("canonical_url"),
        F.try_to_timestamp(own["warc-date"]).alias("warc_date"),
        own["warc-profile"].alias("profile"),
        F.when(status != "", status.cast("int")).alias("status"),
        header_map(F.col("__http")).alias("headers"),
    )


def is_not_modified() -> Column:
    profile = F.coalesce(F.col("profile"), F.lit("")).rlike(r"server-not-modified/?$")
    return F.coalesce((F.col("warc_type") == "revisit") & (profile | (F.col("status") == 304)), F.lit(False))


def is_full() -> Column:
    return F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200), F.lit(False))


def _plain_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def outcome(stored: Column, own: Column) -> Column:
    """Weak comparison of ETags, else of Last-Modified, as far as both have them."""
    tags = stored["etag"].isNotNull() & own["etag"].isNotNull()
    dates = stored["last-modified"].isNotNull() & own["last-modified"].isNotNull()
    return (
        F.when(stored.isNull(), "missing")
        .when(tags, F.when(_plain_tag(stored["etag"]) == _plain_tag(own["etag"]), "resolved").otherwise("mismatch"))
        .when(dates, F.when(stored["last-modified"] == own["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )


def merged_headers(stored: Column, own: Column) -> Column:
    """Stored headers, with those renewed that a 304 may renew, by name."""
    renewed = F.map_filter(own, lambda k, v: k.isin(*RENEWED))
    old = F.map_filter(stored, lambda k, v: ~F.map_contains_key(renewed, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(old), F.map_entries(renewed))))


def latest_full(records: DataFrame) -> DataFrame:
    """Each record with ``full``: id, headers of the latest full response up to it."""
    # A response sorts before a revisit of the same date.
    order = [F.col("canonical_url"), F.col("warc_date"), F.col("kind"), F.col("record_id")]
    rows = records.withColumn("kind", F.when(is_full(), 0).otherwise(1))
    response = F.when(is_full(), F.struct("record_id", "headers"))
    parts = rows.repartitionByRange(*order).withColumns({"__part": F.spark_partition_id(), "__full": response})
    parts = materialize(parts, "captures")
    within = Window.partitionBy("__part", "canonical_url").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)

    # One row per partition: its first and last URL and what the last one ends with.
    ends = parts.groupBy("__part").agg(F.min("canonical_url").alias("low"), F.max("canonical_url").alias("high"))
    tail = parts.filter("__full is not null").join(F.broadcast(ends), "__part").filter(F.col("canonical_url") == F.col("high"))
    tail = tail.groupBy("__part").agg(F.max_by("__full", F.struct("warc_date", "record_id")).alias("tail"))
    ends = ends.join(tail, "__part", "left")
    so_far = Window.partitionBy("high").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("carried", F.last("tail", ignorenulls=True).over(so_far))
    before = Window.orderBy("__part")
    ends = ends.withColumns({"from_url": F.lag("high").over(before), "from_full": F.lag("carried").over(before)})
    carry = ends.select("__part", "from_url", "from_full")

    found = parts.withColumn("__here", F.last("__full", ignorenulls=True).over(within)).join(F.broadcast(carry), "__part")
    carried = F.when(F.col("canonical_url") == F.col("from_url"), F.col("from_full"))
    return found.withColumn("full", F.when(F.col("canonical_url").isNotNull(), F.coalesce("__here", carried))).drop(
        "__part", "__full", "__here", "from_url", "from_full", "kind"
    )


def resolve(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit of parsed records.

    ``record_id, canonical_url, warc_date, outcome, response_id, headers``: the
    response is given unless missing, merged headers unless missing or mismatched.
    """
    fields = ("record_id", "warc_type", "canonical_url", "warc_date", "profile", "status", "headers")
    # Written before anything is asked of it, so each record is parsed once.
    narrow = materialize(records.select(*fields), "records").filter(is_full() | is_not_modified())
    revisits = latest_full(narrow).filter(is_not_modified())
    stored, own = F.col("full.headers"), F.col("headers")
    result = outcome(stored, own)
    return revisits.select(
        "record_id",
        "canonical_url",
        "warc_date",
        result.alias("outcome"),
        F.col("full.record_id").alias("response_id"),
        F.when(result.isin("resolved", "unchecked"), merged_headers(stored, own)).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, body: Column) -> DataFrame:
    """Resolved revisits with the body of their response, for writing them out."""
    bodies = records.filter(is_full()).select(F.col("record_id").alias("__id"), body.alias("body"))
    return resolved.join(bodies, F.col("response_id") == F.col("__id"), "left").drop("__id")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records as strings for a table of pages, for want of an archive.

    Every page gives one response (some are errors) and two later or earlier
    revisits, some with another ETag, some with none; all follow from its columns.
    """
    end = "\r\n"
    number = F.coalesce(F.col("page_id"), F.lit(0))
    hour = F.pmod(number * 37, F.lit(2000))
    stamp = lambda h: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + h * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.substring(F.md5(html), 1, 12)
    uri = F.coalesce(F.col("url"), F.lit(""))

    def record(kind: str, name: Column, date: Column, extra: str, http: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{end}WARC-Type: {kind}{end}WARC-Record-ID: <urn:"),
            name,
            F.lit(f">{end}WARC-Target-URI: "),
            uri,
            F.lit(f"{end}WARC-Date: "),
            date,
            F.lit(f"{end}{extra}{end}"),
            http,
        )

    ok = F.when(number % 29 == 0, "404 Not Found").otherwise("200 OK")
    full_tag = F.when(number % 5 != 0, F.concat(F.lit('ETag: "'), tag, F.lit(f'"{end}'))).otherwise("")
    full = F.concat(
        F.lit("HTTP/1.1 "), ok, F.lit(f"{end}Content-Type: text/html{end}"), full_tag,
        F.lit("Last-Modified: "), stamp(hour - 50), F.lit(f"{end}Content-Length: "), F.octet_length(html).cast("string"),
        F.lit(f"{end}Cache-Control: max-age=60{end}{end}"), html,
    )
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n"

    def revisit(k: int) -> Column:
        later = hour + F.pmod(number * 13 + k * 7, F.lit(60)) - 10
        changed = F.when(number % 7 == k, "x").otherwise(tag)
        own = F.when(number % 11 != k, F.concat(F.lit('ETag: W/"'), changed, F.lit(f'"{end}'))).otherwise("")
        http = F.concat(
            F.lit(f"HTTP/1.1 304 Not Modified{end}"), own, F.lit("Date: "), stamp(later),
            F.lit(f"{end}Content-Length: 0{end}Cache-Control: max-age={60 + k}{end}{end}"),
        )
        return record("revisit", F.concat(F.col("page_id").cast("string"), F.lit(f"-v{k}")), stamp(later), profile, http)

    rows = F.array(record("response", F.col("page_id").cast("string"), stamp(hour), "", full), revisit(1), revisit(2))
    return pages.select(F.explode(rows).alias("record"))
