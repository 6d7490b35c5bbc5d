import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakekin import PAIR, SketchOptions
from lakekin.operators import search, sketch
from lakekin.operators.pairs import LakeTable, lake_means, query_means, sketch_candidates, sketch_means, wide_pair_means
from lakekin.operators.profile import key_columns, measure_columns

QUERY = ("Country", "Life expectancy ")


def counts(index, query, opts):
    rows = search.match_counts(index, query, opts).collect()
    return {(r["value_col"], r["side"]): r["matches"] for r in rows}


def both(found):
    return {m: (found.get((m, "+"), 0), found.get((m, "-"), 0)) for m in ("Alcohol", "BMI", "Area(sq.mi.)")}


@pytest.mark.parametrize(
    "order, size, expected",
    [
        ("be", 5, [(1, 4), (4, 1), (2, 3)]),
        ("le_signed", 5, [(1, 4), (5, 0), (3, 2)]),
        ("be", 100, [(2, 8), (8, 2), (4, 6)]),
    ],
)
def test_known_counts(countries, order, size, expected):
    table, query = countries
    opts = SketchOptions(size=size, hash_order=order)
    means = wide_pair_means(table, "t", key_columns(table), measure_columns(table))
    index = sketch.term_index(means, opts)
    assert list(both(counts(index, query_means(query, *QUERY), opts)).values()) == expected


def test_known_sketch(countries):
    _, query = countries
    means = query_means(query, *QUERY)
    for order, keys in {
        "be": ["United States of America", "Nicaragua", "Montenegro", "Nigeria", "Paraguay"],
        "le_signed": [
            "Armenia", "Nicaragua", "Equatorial Guinea", "United States of America", "Colombia",
        ],
    }.items():
        kept = sketch.pair_sketch(means, SketchOptions(size=5, hash_order=order))
        assert [r["key"] for r in kept.orderBy("sketch_rank").collect()] == keys


def test_self_search_and_negation(countries):
    _, query = countries
    opts = SketchOptions(size=7)
    means = query_means(query, *QUERY)
    negated = query_means(query.withColumn("n", -F.col("`Life expectancy `")), "Country", "n")
    index = sketch.term_index(means, opts)
    same = {s: n for (_, s), n in counts(index, means, opts).items()}
    swapped = {s: n for (_, s), n in counts(index, negated, opts).items()}
    assert same == {"+": 7}
    assert swapped == {"-": 7}


def test_output_forms(countries):
    table, query = countries
    opts = SketchOptions(size=5)
    index = sketch.term_index(
        wide_pair_means(table, "a__b", ["Country"], ["Alcohol", "BMI"]), opts
    )
    means = query_means(query, *QUERY)
    signed = search.search_signed(index, means, 10, opts).collect()
    assert [(r["id"], r["count"]) for r in signed] == [
        ("a__b__Country_Alcohol-QMinus", 4),
        ("a__b__Country_BMI-QPlus", 4),
        ("a__b__Country_Alcohol-QPlus", 1),
        ("a__b__Country_BMI-QMinus", 1),
    ]
    assert signed[0]["table_id"] == "a__b"
    absolute = search.search_absolute(index, means, 2, opts).collect()
    assert [(r["id"], r["qcr_score"], r["abs_qcr_score"]) for r in absolute] == [
        ("a__b_|_Country_|_Alcohol", -4, 4),
        ("a__b_|_Country_|_BMI", 4, 4),
    ]
    counter = search.search_counter(index, means, opts, k=1, query_size=5).collect()
    assert [(r["id"], r["count"]) for r in counter] == [("+:a__b_|_Country_|_BMI", 4)]


def test_bottom_k_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(900)}", rng.gauss(0, 1)) for _ in range(6000)]
    rows += [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [(None, 1.0), ("k1", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(7)
    groups = {}
    for k, v in rows:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    means = {k: sum(v) / len(v) for k, v in groups.items()}
    best = sorted(means, key=lambda k: hashlib.md5(k.encode()).digest())[:128]
    kept = sketch.with_mean(sketch.pair_sketch(query_means(df, "key", "v"))).collect()
    assert {r["key"] for r in kept} == set(best)
    centre = sum(means[k] for k in best) / 128
    for row in kept:
        assert row["value"] == pytest.approx(means[row["key"]])
        assert row["mean"] == pytest.approx(centre)
    plan = sketch.pair_sketch(query_means(df, "key", "v"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("size", [1, 16, 128])
def test_two_passes_give_the_same_sketch(spark, size):
    rng = random.Random(9)
    rows = [
        (f"k{rng.randrange(4000)}", f"z{rng.randrange(5)}", rng.gauss(0, 1), None if rng.random() < 0.97 else 1.0)
        for _ in range(9000)
    ]
    df = spark.createDataFrame(rows, "a string, b string, full double, rare double").repartition(6)
    lake = [LakeTable("t", df, ("a", "b"), ("full", "rare")), LakeTable("u", df, ("a",), ("full",))]
    opts = SketchOptions(size=size)
    want = sketch.pair_sketch(lake_means(lake), opts).select(*PAIR, "key", "sketch_rank")
    candidates = sketch_candidates(lake, size)
    got = sketch.pair_sketch(candidates, opts).select(*PAIR, "key", "sketch_rank")
    assert sorted(got.collect()) == sorted(want.collect())
    dense = "table_id = 't' AND key_col = 'a' AND value_col = 'full'"
    lone = sketch_candidates(lake[1:], 16)
    assert lone.count() < 40 and candidates.where(dense).count() > 0


def test_large_sketch_is_limited_before_the_shuffle(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    means = query_means(df, "key", "v")
    kept = sketch.pair_sketch(means, SketchOptions(size=1500))
    order = sorted((str(i) for i in range(5000)), key=lambda k: hashlib.md5(k.encode()).digest())
    assert [r["key"] for r in kept.orderBy("sketch_rank").collect()] == order[:1500]


def test_sketch_of_all_keys_is_the_mean_table(countries):
    table, _ = countries
    means = wide_pair_means(table, "t", ["Country"], ["BMI"])
    kept = sketch.pair_sketch(means, SketchOptions(size=10)).select(*PAIR, "key", "value")
    assert sorted(kept.collect()) == sorted(means.collect())


def test_custom_hash_and_xxhash(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    means = query_means(df, "key", "v")

    def own_hash(key):
        return F.xxhash64(key)

    with pytest.raises(ValueError, match="name"):
        SketchOptions(hash_order=lambda key: F.xxhash64(key))
    custom = SketchOptions(size=20, hash_order=own_hash)
    named = SketchOptions(size=20, hash_order="xxhash64")
    one, two = (
        {r["key"] for r in sketch.pair_sketch(means, o).collect()} for o in (custom, named)
    )
    assert one == two and len(one) == 20


def test_odd_names_and_size_gate(spark):
    df = spark.createDataFrame(
        [("a", 1), ("b", 3), ("a", 2)], "`k.e{y}` string, `it's` int"
    )
    means = wide_pair_means(df, "o'{x}", ["k.e{y}"], ["it's"])
    assert sorted((r["table_id"], r["key_col"], r["value_col"], r["key"], r["value"]) for r in means.collect()) == [
        ("o'{x}", "k.e{y}", "it's", "a", 1.5),
        ("o'{x}", "k.e{y}", "it's", "b", 3.0),
    ]
    assert wide_pair_means(df, "t", ["k.e{y}"], ["it's"], min_rows=4).count() == 0
    assert wide_pair_means(df, "t", ["k.e{y}"], ["it's"], min_rows=3).count() == 2
    with pytest.raises(ValueError):
        wide_pair_means(df, "t", ["k.e{y}"], ["it's"], agg="sum")
    with pytest.raises(ValueError):
        lake_means([])


def test_clean_keys_merge(spark):
    df = spark.createDataFrame([("Bear ", 1.0), (" bear", 3.0)], "k string, v double")
    row = wide_pair_means(df, "t", ["k"], ["v"], clean_keys=True).collect()
    assert [(r["key"], r["value"]) for r in row] == [("bear", 2.0)]


def test_constant_measure_sits_on_the_minus_label(spark, countries):
    _, query = countries
    flat = query.withColumn("flat", F.lit(1.0))
    opts = SketchOptions(size=10)
    index = sketch.term_index(wide_pair_means(flat, "t", ["Country"], ["flat"]), opts)
    found = counts(index, query_means(query, *QUERY), opts)
    assert found[("flat", "+")] + found[("flat", "-")] == 10


def test_toy_lake_ranks_correlated_tables_first(spark):
    lake = spark.range(100).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"),
        (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1).alias("master"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2001)) / 1000.0 - 1).alias(f"noise_{i}") for i in range(6)],
    )
    for i in range(6):
        lake = lake.withColumn(f"close_{i}", F.col("master") + 0.5 * F.col(f"noise_{i}"))
    measures = [c for c in lake.columns if c.startswith(("noise", "close"))]
    opts = SketchOptions(size=64)
    index = sketch.term_index(wide_pair_means(lake, "toy", ["id"], measures), opts)
    top = search.search_signed(index, query_means(lake, "id", "master"), 6, opts).collect()
    assert {r["value_col"] for r in top} == {f"close_{i}" for i in range(6)}
    assert {r["side"] for r in top} == {"+"}


@pytest.mark.parametrize("order", ["be", "sha2", "le_signed", "xxhash64"])
def test_keys_that_no_sketch_holds_are_dropped_unsorted(spark, order):
    df = spark.range(6000).selectExpr(
        "concat('k', id % 4000) AS a", "concat('z', id % 5) AS b", "id AS full", "IF(id % 50 = 0, id, NULL) AS rare"
    )
    lake = [LakeTable("t", df, ("a", "b"), ("full", "rare")), LakeTable("u", df, ("a",), ("full",))]
    opts = SketchOptions(size=64, hash_order=order)
    means = sketch_means(lake, opts)
    got = sketch.pair_sketch(means, opts).select(*PAIR, "key", "value", "sketch_rank").collect()
    want = sketch.pair_sketch(lake_means(lake), opts).select(*PAIR, "key", "value", "sketch_rank").collect()
    assert sorted(got) == sorted(want)
    if order != "xxhash64":
        # Two large pairs keep the sketch and the rest of its last bin, the small ones all.
        assert means.where("key_col = 'a' AND value_col = 'full'").count() < 2 * (64 + 16)
        plan = means._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
