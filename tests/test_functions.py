import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekin import SketchOptions
from lakekin.functions.hashing import key_hash, sign_label, term
from lakekin.functions.numeric import clean_text, guarded, parse_number
from lakekin.functions.stats import incomplete_beta, one_sided_p, score, t_quantile, t_statistic, t_upper_tail, two_sided_p


@pytest.mark.parametrize(
    "text, expected",
    [
        ("5d", None), ("5f", None), ("5D", None), ("0x10", None), ("0x1p3", None), ("1_000", None),
        ("1,5", None), ("", None), ("true", None), ("abc", None), (None, None),
        ("1e5", 1e5), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), (" 5 ", 5.0), ("-2.25", -2.25),
        ("inf", math.inf), ("-Infinity", -math.inf), ("1e400", math.inf), ("nan", math.nan),
    ],
)
def test_parse_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "c string")
    value = df.select(parse_number(F.col("c")).alias("v")).first()["v"]
    if expected is not None and math.isnan(expected):
        assert math.isnan(value)
    else:
        assert value == expected


def test_guard_and_cleaning(spark):
    df = spark.createDataFrame(
        [(math.nan,), (math.inf,), (1e291,), (-1e289,), (None,)], "v double"
    )
    kept = [r[0] for r in df.select(guarded(F.col("v"))).collect()]
    assert kept == [None, None, None, -1e289, None]
    text = spark.createDataFrame([(" \tBear ",)], "c string").select(clean_text(F.col("c")))
    assert text.first()[0] == "bear"


def test_hash_orders_match_integers(spark):
    keys = [f"key {i}é" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    digest = {k: hashlib.md5(k.encode()).digest() for k in keys}
    expected = {
        "be": sorted(keys, key=lambda k: int.from_bytes(digest[k], "big")),
        "le_signed": sorted(keys, key=lambda k: int.from_bytes(digest[k], "little", signed=True)),
        "sha2": sorted(keys, key=lambda k: hashlib.sha256(k.encode()).hexdigest()),
    }
    for order, want in expected.items():
        opts = SketchOptions(hash_order=order)
        got = [r[0] for r in df.orderBy(key_hash(F.col("key"), opts)).collect()]
        assert got == want


def test_terms(spark):
    df = spark.createDataFrame([("Germany",)], "key string")

    def made(**options):
        return df.select(term(F.col("key"), F.lit("+1"), SketchOptions(**options))).first()[0]

    assert made() == hashlib.md5(b"Germany+1").hexdigest()
    assert made(term="hex") == b"Germany+1".hex().rjust(32, "0")
    inner = hashlib.md5(b"Germany").hexdigest()
    assert made(inner_hash=True) == hashlib.md5(f"{inner}+1".encode()).hexdigest()
    long_key = "x" * 40
    long = spark.createDataFrame([(long_key,)], "key string")
    got = long.select(term(F.col("key"), F.lit("-1"), SketchOptions(term="hex"))).first()[0]
    assert got == f"{long_key}-1".encode().hex()


def test_labels(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")

    def labels(negate=False, **options):
        column = sign_label(F.col("v"), F.lit(2.0), SketchOptions(**options), negate)
        return [r[0] for r in df.orderBy("v").select(column).collect()]

    assert labels() == ["-1", "-1", "+1"]
    assert labels(negate=True) == ["+1", "-1", "-1"]
    assert labels(label="sql") == ["+1", "-1", "-1"]
    assert labels(rel_eps=0.6) == ["-1", "-1", "-1"]


def test_bad_options():
    for bad in ({"size": 0}, {"hash_order": "crc"}, {"label": "x"}, {"term": "x"}):
        with pytest.raises(ValueError):
            SketchOptions(**bad)


def test_t_distribution():
    assert incomplete_beta(np.array(2.0), np.array(3.0), np.array(0.5)) == pytest.approx(0.6875)
    assert t_upper_tail(np.array(2.0), np.array(10.0)) == pytest.approx(0.0366940173853, rel=1e-9)
    assert t_upper_tail(np.array(-1.0), np.array(1.0)) == pytest.approx(0.75, rel=1e-12)
    assert t_upper_tail(np.array(0.0), np.array(7.0)) == pytest.approx(0.5)
    assert t_quantile(0.995, 19) == pytest.approx(2.8609346064, rel=1e-8)


def test_score_weights(spark):
    df = spark.createDataFrame([(0.25, -0.81)], "j double, r double")
    half, tilted = df.select(
        score(F.col("j"), F.col("r")), score(F.col("j"), F.col("r"), 0.75)
    ).first()
    assert half == pytest.approx(math.sqrt(0.25 * 0.81))
    assert tilted == pytest.approx(0.25**0.25 * 0.81**0.75)
    with pytest.raises(ValueError):
        score(F.col("j"), F.col("r"), 1.5)


def test_p_values_as_columns(spark):
    rows = [(t, float(df)) for df in (1, 2, 3, 7, 30, 400, 5000, 100_000) for t in (0.0, 0.1, 1.2, 1.5, 5.0, -1.3, 1e8)]
    df = spark.createDataFrame(rows + [(None, 3.0), (1.0, 0.0)], "t double, df double")
    for r in df.select("t", "df", one_sided_p(F.col("t"), F.col("df")).alias("p")).collect():
        if r["t"] is None or not r["df"]:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(float(t_upper_tail(np.array(r["t"]), np.array(r["df"]))), rel=1e-9, abs=1e-300)
    # At 10^9 degrees of freedom the normal distribution is right to nine digits.
    wide = spark.createDataFrame([(1.959963984540054, 1e9)], "t double, df double")
    assert wide.select(one_sided_p(F.col("t"), F.col("df"))).first()[0] == pytest.approx(0.025, rel=1e-7)
    r, n = F.col("r"), F.col("n")
    rows = [(0.5, 10), (-0.5, 10), (1.0, 9), (-1.0, 9), (0.0, 9), (0.3, 2), (None, 9), (float("nan"), 9)]
    found = spark.createDataFrame(rows, "r double, n long").select(two_sided_p(r, t_statistic(r, n), n).alias("p")).collect()
    # Of r = 0.5 and n = 10 by the finite series.
    want = 1 - 0.5 * sum(math.comb(2 * k, k) / 4**k * 0.75**k for k in range(4))
    assert [x["p"] for x in found[:5]] == [pytest.approx(want), pytest.approx(want), 0.0, 0.0, 1.0]
    assert [x["p"] for x in found[5:]] == [None, None, None]
