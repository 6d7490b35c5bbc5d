import random

import pytest
from pyspark.sql import functions as F

from lakekin.llm import warc_revisit as w


def record(kind, name, url, date, http, extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}\r\n{http}"


def response(name, url, date, headers="", status="200 OK"):
    return record("response", name, url, date, f"HTTP/1.1 {status}\r\n{headers}\r\nbody\r\n\r\nmore")


def revisit(name, url, date, headers=""):
    return record("revisit", name, url, date, f"HTTP/1.1 304 Not Modified\r\n{headers}\r\n")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80/A/b/?b=2&utm_source=x&a=1#frag", "example.com/A/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("example.com/?", "example.com"),
        ("https://example.com:8080/x?ref=a", "example.com:8080/x"),
        ("http://example.com/x?reference=a", "example.com/x?reference=a"),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(w.canonical_url(F.col("u"))).first()[0] == want


def resolved(spark, records):
    df = spark.createDataFrame([(r, 1, "x") for r in records], "record string, status int, headers string").select("record")
    rows = w.resolve(w.parse_records(df)).collect()
    return {r["record_id"]: r for r in rows}


def test_outcomes(spark):
    u = "http://e.org/p"
    old = 'ETag: "1"\r\nLast-Modified: A\r\nContent-Length: 9\r\nX: 1\r\nx: 2\r\n'
    found = resolved(
        spark,
        [
            response("r0", u, "2024-01-01T00:00:00Z", old),
            response("r1", "https://www.e.org/p#f", "2024-01-03T00:00:00Z", 'ETag: "2"\r\n'),
            response("err", u, "2024-01-04T00:00:00Z", status="500 Oops"),
            revisit("early", u, "2023-12-31T00:00:00Z", 'ETag: "1"\r\n'),
            revisit("same", u, "2024-01-02T00:00:00Z", 'ETag: W/"1"\r\nContent-Length: 0\r\nDate: D\r\nX: 3\r\n'),
            revisit("tie", u, "2024-01-03T00:00:00Z", 'ETag: "2"\r\n'),
            revisit("other", u, "2024-01-05T00:00:00Z", 'ETag: "1"\r\n'),
            revisit("dated", u, "2024-01-02T00:00:00Z", "Last-Modified: A\r\n"),
            revisit("redated", u, "2024-01-02T00:00:00Z", "Last-Modified: B\r\n"),
            revisit("bare", u, "2024-01-06T00:00:00Z"),
            revisit("nowhere", "", "2024-01-06T00:00:00Z"),
            record("request", "q", u, "2024-01-06T00:00:00Z", "GET / HTTP/1.1\r\n"),
            "no record",
            "",
            None,
        ],
    )
    assert {k: (r["outcome"], r["response_id"]) for k, r in found.items()} == {
        "early": ("missing", None),
        "same": ("resolved", "r0"),
        "tie": ("resolved", "r1"),
        "other": ("mismatch", "r1"),
        "dated": ("resolved", "r0"),
        "redated": ("mismatch", "r0"),
        "bare": ("unchecked", "r1"),
        "nowhere": ("missing", None),
    }
    assert found["same"]["headers"] == {"etag": 'W/"1"', "last-modified": "A", "content-length": "9", "x": "1, 2", "date": "D"}
    assert found["other"]["headers"] is None


def test_hot_url_over_many_partitions(spark):
    rng = random.Random(1)
    records, events = [], []
    for i in range(600):
        url = "http://hot.org/" if i % 3 else f"http://h{rng.randrange(40)}.org/"
        day, full = rng.randrange(200), rng.random() < 0.02
        date = f"2024-{1 + day // 28:02d}-{1 + day % 28:02d}T00:00:00Z"
        events.append((url, date, 0 if full else 1, f"n{i:03d}"))
        records.append(response(f"n{i:03d}", url, date) if full else revisit(f"n{i:03d}", url, date))
    last, want = {}, {}
    for url, _, kind, name in sorted(events):
        if kind:
            want[name] = last.get(url)
        else:
            last[url] = name
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = resolved(spark, records)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {k: r["response_id"] for k, r in found.items()} == want


def test_repeated_and_empty(spark):
    one = revisit("v", "http://e.org/", "2024-01-02T00:00:00Z")
    df = spark.createDataFrame([(one,), (one,)], "record string")
    parsed = w.parse_records(df)
    assert w.resolve(parsed).count() == 2
    assert w.resolve(parsed.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, None, None), (None, "http://x.org", "<p>")], "page_id long, url string, html string")
    assert w.captures_of_pages(pages).count() == 6


def test_payload(spark):
    u = "http://e.org/p"
    df = spark.createDataFrame([(response("r", u, "2024-01-01T00:00:00Z"),), (revisit("v", u, "2024-01-02T00:00:00Z"),)], "record string")
    parsed = w.parse_records(df)
    body = F.regexp_extract("record", r"(?s)\r\n\r\n.*?\r\n\r\n(.*)", 1)
    row = w.with_payload(w.resolve(parsed), parsed, body).first()
    assert row["body"] == "body\r\n\r\nmore"
