import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekin.operators import exact
from lakekin.operators.pairs import LakeTable, lake_means, wide_pair_means


@pytest.fixture(scope="module")
def animals(spark):
    query = spark.createDataFrame(
        [("Dog", 65.0), ("Cat", 20.0), ("Elephant", 300.0), ("Horse", 150.0), ("Lion", 100.0)],
        "key string, value double",
    )
    weight = [("Dog", 30), ("Bear", 500), ("Cat", 5), ("Elephant", 3500), ("Horse", 1000)]
    deaths = [
        ("Dog", 4), ("Cat", 1), ("Elephant", 20), ("Bear ", 40), ("Horse", 30), ("Guns", 10000),
        ("Smoking", 40000), ("Plane crash", 100), ("Sharks", 5),
    ]
    mascots = [("Lion", 86), ("Dog", 65), ("Elephant", 75)]
    lake = [
        LakeTable(name, spark.createDataFrame(rows, "name string, n int"), ("name",), ("n",))
        for name, rows in (("weight", weight), ("deaths", deaths), ("mascots", mascots))
    ]
    return lake, query


@pytest.mark.parametrize("small", [True, False])
def test_containment_first(animals, small):
    lake, query = animals
    rows = exact.containment_first(lake, query, p_values=True, small_query=small).collect()
    found = {r["table_id"]: r for r in rows}
    assert found["weight"]["containment"] == pytest.approx(0.8)
    assert found["weight"]["correlation"] == pytest.approx(0.979603, abs=1e-6)
    assert found["deaths"]["correlation"] == pytest.approx(0.677304, abs=1e-6)
    assert found["mascots"]["containment"] == pytest.approx(0.6)
    assert found["mascots"]["correlation"] == pytest.approx(0.110755, abs=1e-6)
    # r = 0.979603 with 2 degrees of freedom: p = 1 - r for n = 4.
    assert found["weight"]["p_value"] == pytest.approx(1 - 0.979603, abs=1e-6)
    assert exact.containment_first(lake, query, threshold=0.7, small_query=small).count() == 2


def test_first_column_wins_ties(spark, animals):
    _, query = animals
    df = spark.createDataFrame([("Dog", "Dog", 1), ("Cat", "Cat", 2), ("Lion", "Lion", 4)], "z string, a string, n int")
    row = exact.containment_first([LakeTable("t", df, ("z", "a"), ("n",))], query).collect()
    assert [r["key_col"] for r in row] == ["z"]


@pytest.fixture(scope="module")
def random_lake(spark):
    rng = random.Random(5)
    query = [(f"k{i}", rng.gauss(10, 3)) for i in range(40)]
    rows = []
    for _ in range(500):
        # One key holds a third of all rows.
        key = "k7" if rng.random() < 0.33 else f"k{rng.randrange(60)}"
        measure = None if rng.random() < 0.1 else rng.gauss(1000, 5)
        rows.append((key, rng.choice(["x", "y"]), measure, 4.0, rng.randrange(9)))
    df = spark.createDataFrame(rows, "k string, other string, m double, flat double, n int")
    frame = spark.createDataFrame(query, "key string, value double")
    return LakeTable("t", df.repartition(5), ("k", "other"), ("m", "flat", "n")), frame, rows, dict(query)


@pytest.mark.parametrize("small", [True, False, None])
def test_exact_against_brute_force(random_lake, small):
    table, query, rows, values = random_lake
    found = {
        (r["key_col"], r["value_col"]): r
        for r in exact.search_exact([table], query, small_query=small).collect()
    }
    assert set(found) == {("k", "m"), ("k", "flat"), ("k", "n")}
    for name, place in (("m", 2), ("n", 4)):
        groups = {}
        for row in rows:
            if row[place] is not None:
                groups.setdefault(row[0], []).append(row[place])
        shared = [k for k in groups if k in values]
        r = np.corrcoef([values[k] for k in shared], [np.mean(groups[k]) for k in shared])[0, 1]
        got = found[("k", name)]
        assert got["correlation"] == pytest.approx(r, abs=1e-9)
        assert got["joinability"] == pytest.approx(len(shared) / 40)
    assert found[("k", "flat")]["correlation"] == 0.0


def test_degenerate_cases(spark):
    query = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0)], "key string, value double")
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, None), ("c", 7.0, None)], "k string, v double, one double")
    rows = exact.search_exact([LakeTable("t", df, ("k",), ("v", "one"))], query).collect()
    found = {r["value_col"]: r for r in rows}
    assert found["v"]["correlation"] is None  # constant query
    assert found["one"]["correlation"] == 0.0 and found["one"]["n"] == 1
    top = exact.exact_topk(exact.search_exact([LakeTable("t", df, ("k",), ("v", "one"))], query), 5)
    assert top.count() == 2


def test_row_join_statistics_equal_the_real_join(spark, random_lake):
    table, _, rows, _ = random_lake
    rng = random.Random(8)
    ours = [(f"k{rng.randrange(12)}", None if rng.random() < 0.1 else rng.gauss(0, 1)) for _ in range(90)]
    query = LakeTable("q", spark.createDataFrame(ours, "key string, v double"), ("key",), ("v",))
    found = {r["value_col"]: r for r in exact.overlap_rank_corr([table], query).collect()}
    for name, place in (("m", 2), ("n", 4)):
        pairs = [(q[1], r[place]) for q in ours for r in rows if q[0] == r[0]]
        both = [(x, y) for x, y in pairs if x is not None and y is not None]
        r = np.corrcoef(*zip(*both))[0, 1]
        assert found[name]["joinability"] == len(pairs)
        assert found[name]["correlation"] == pytest.approx(r, abs=1e-9)
    assert found["flat"]["correlation"] is None


def test_overlap(animals):
    lake, query = animals
    rows = exact.overlap_topk(lake, query, k=2).collect()
    assert [(r["table_id"], r["overlap"]) for r in rows] == [("deaths", 4), ("weight", 4)]


def test_small_query_filters_before_the_aggregation(spark, random_lake):
    table, query, _, _ = random_lake
    keys = exact.filter_keys(query)
    plan = exact.lake_means([table], only_keys=keys)._jdf.queryExecution().optimizedPlan().toString()
    join, aggregate = plan.index("LeftSemi"), plan.index("Aggregate")
    assert aggregate < join  # plans print the root first
    assert exact.filter_keys(spark.range(200_000).select(F.col("id").cast("string").alias("key"))) is None
    wide = spark.range(600).select(F.repeat(F.lit("x"), 100_000).alias("key"))
    assert exact.filter_keys(wide) is None


def test_unused_columns_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("string(id) k", "id v", "id surplus").write.parquet(path)
    plan = wide_pair_means(spark.read.parquet(path), "t", ["k"], ["v"])
    assert "surplus" not in plan._jdf.queryExecution().executedPlan().toString()


def test_several_query_columns_at_once(spark):
    rows = [(f"a{i}", f"b{i % 7}", float(i), float(i * i % 11)) for i in range(40)]
    table = spark.createDataFrame(rows, "k1 string, k2 string, v1 double, v2 double")
    lake = [LakeTable("lake", table, ("k1", "k2"), ("v1", "v2"))]
    query = LakeTable("q", table.where("v1 < 25"), ("k1", "k2"), ("v1", "v2"))
    found = exact.search_exact_multi(lake, lake_means([query])).collect()
    for key in query.keys:
        for value in query.measures:
            one = exact.search_exact(lake, lake_means([LakeTable("q", query.df, (key,), (value,))]).select("key", "value"))
            want = {(r["key_col"], r["value_col"]): (r["n"], r["joinability"], r["correlation"]) for r in one.collect()}
            got = {
                (r["key_col"], r["value_col"]): (r["n"], r["joinability"], r["correlation"])
                for r in found
                if (r["query_key"], r["query_value"]) == (key, value)
            }
            assert got.keys() == want.keys()
            for pair in want:
                assert got[pair] == pytest.approx(want[pair], nan_ok=True)


def test_cells_are_not_exchanged_by_table(spark):
    """One large table must not meet the list of matched tables in one task."""
    cells = spark.range(400).selectExpr(
        "'t' AS table_id", "id DIV 2 AS row_id", "CAST(id % 2 AS INT) AS column_id",
        "CASE WHEN id % 2 = 0 THEN 'k' ELSE 'v' END AS column_name",
        "CASE WHEN id % 2 = 0 THEN concat('key', id DIV 2 % 5) ELSE CAST(id AS STRING) END AS cell",
        "CASE WHEN id % 2 = 1 THEN CAST(id AS DOUBLE) END AS num",
    )
    query = spark.createDataFrame([(f"key{i}", float(i * i)) for i in range(4)], "key string, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact.search_exact_cells(cells, query)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_table = [l for l in plan.splitlines() if "Exchange hashpartitioning(table_id#" in l and l.count("#") == 2]
    assert by_table == []
    row = found.first()
    assert (row["n"], row["joinability"]) == (4, 1.0)
