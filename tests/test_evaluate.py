import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.functions.stats import t_quantile
from lakekin.operators.pairs import LakeTable
from lakekin.operators import augment, evaluate, gram, models, split
from lakekin.session import materialize


def test_metrics_against_numpy(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", rng.gauss(5, 2), rng.gauss(5, 2)) for _ in range(801)]
    rows += [("tied", 1.0, float(i % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows + [("a", None, 1.0)], "config string, y double, p double")
    for r in evaluate.regression_metrics(df, "y", "p").collect():
        y, p = (np.array(v) for v in zip(*[(b, c) for a, b, c in rows if a == r["config"]]))
        e = y - p
        assert r["n"] == len(y)
        assert r["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert r["mse"] == pytest.approx((e**2).mean())
        assert r["mae"] == pytest.approx(np.abs(e).mean())
        assert r["median_ae"] == pytest.approx(np.median(np.abs(e)))
        if r["config"] == "tied":
            assert r["r2"] is None and r["pearson"] is None
        else:
            assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
            assert r["pearson"] == pytest.approx(np.corrcoef(y, p)[0, 1])


@pytest.mark.parametrize("n", [1, 2, 5, 30_000, 30_001])
def test_exact_median(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7).alias("v"))
    values = [r["v"] for r in df.collect()]
    row = evaluate.exact_median(df, "v", ["g"]).first()
    assert row["median"] == pytest.approx(float(np.median(values)), rel=1e-15)


def test_exact_median_draws_brackets_in(spark):
    """Groups of other sizes and shapes, ties at the median, nulls, and a far outlier."""
    v = (
        F.when(F.col("g") == 0, F.col("id").cast("double"))
        .when(F.col("g") == 1, F.lit(3.5))
        .when(F.col("g") == 2, F.pow(F.lit(2.0), F.pmod("id", F.lit(900))))
        .when(F.pmod("id", F.lit(5)) > 0, F.floor(F.rand(1) * 40).cast("double"))
    )
    df = spark.range(20_000).select(F.pmod(F.floor(F.col("id") / 7), F.lit(4)).alias("g"), "id").select("g", v.alias("v"))
    df = df.union(spark.range(1).select(F.lit(0), F.lit(1e300)))
    df = materialize(df, "values")
    values = df.toPandas().dropna().groupby("g")["v"].median()
    for band_rows in (1, 50, 100_000):
        found = {r["g"]: r["median"] for r in evaluate.exact_median(df, "v", ["g"], band_rows=band_rows).collect()}
        assert found == values.to_dict()


def test_quality(spark):
    def ids(*names):
        return spark.createDataFrame([(n, "k", "v") for n in names], "table_id string, key_col string, value_col string")

    row = evaluate.search_quality(ids("a", "b", "c", "d"), ids("a", "b", "x", "x")).first()
    assert (row["n_found"], row["n_common"], row["n_truth"]) == (3, 2, 4)
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == 0.5
    assert row["f1"] == pytest.approx(4 / 7)
    none = evaluate.search_quality(ids("a"), ids("x")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    empty = evaluate.search_quality(ids("a"), ids("x").limit(0)).first()
    assert (empty["n_found"], empty["precision"], empty["f1"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize("n, fraction", [(0, 0.9), (1, 0.9), (7, 0.9), (5003, 0.9), (100, 1.0), (100, 0.0)])
def test_exact_split(spark, n, fraction):
    df = split.exact_split(spark.range(n), F.col("id"), seed=3, fraction=fraction)
    rows = df.collect()
    assert len(rows) == n
    assert sum(r["split"] == "train" for r in rows) == int(fraction * n)
    narrow = split.exact_split(spark.range(n), F.col("id"), seed=3, fraction=fraction, band_rows=0 if n < 50 else 1)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, rows))


def test_hash_split_is_stable_and_stored(spark, tmp_path):
    whole = split.hash_split(spark.range(2000), F.col("id"))
    part = split.hash_split(spark.range(500, 900), F.col("id"))
    known = {r["id"]: r["split"] for r in whole.collect()}
    assert all(known[r["id"]] == r["split"] for r in part.collect())
    share = sum(s == "train" for s in known.values()) / 2000
    assert abs(share - 0.9) < 0.03
    path = str(tmp_path / "split")
    split.save_split(whole, path)
    train, test = split.load_split(spark, path)
    assert {r["id"] for r in train.collect()} == {i for i, s in known.items() if s == "train"}
    assert train.count() + test.count() == 2000


def test_augmentation(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, id int")
    new = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("z", 9.0), (None, 5.0)], "key string, v double")
    joined = augment.augment_mean(base, "k", new, "key", "v", "mean")
    assert sorted((r["id"], r["mean"]) for r in joined.collect()) == [(1, 2.0), (2, 2.0), (3, None), (4, None)]
    found = spark.createDataFrame(
        [("a", 1.0, 1.0, 8.0), ("a", 1.0, 3.0, 8.0), ("b", None, 4.0, 8.0)],
        "k string, x double, y double, unused double",
    )
    lake = [LakeTable("t", found, ("k",), ("x", "y", "unused")), LakeTable("u", new, ("key",), ("v",))]
    hits = spark.createDataFrame(
        [("t", "k", "x", 5), ("t", "k", "y", 9), ("t", "k", "y", 3)],
        "table_id string, key_col string, value_col string, count long",
    )
    ranked = augment.ranked_hits(hits, "count", 2)
    assert [(r["place"], r["value_col"]) for r in ranked.orderBy("place").collect()] == [(1, "y"), (2, "x")]
    wide = augment.augment_hits(base, "k", lake, ranked, 2)
    assert sorted((r["id"], r["hit_1"], r["hit_2"]) for r in wide.collect()) == [
        (1, 2.0, 1.0), (2, 2.0, 1.0), (3, 4.0, None), (4, None, None),
    ]
    assert augment.augment_hits(base, "k", lake, ranked, 2, skip_first=1).columns == ["k", "id", "hit_2"]
    grouped = augment.group_base(base, "k", ["id"], label="id")
    assert {(r["k"], r["id"]) for r in grouped.collect()} == {("a", 1.5), ("b", 3.0), (None, 4.0)}
    assert augment.drop_columns(base, "k").columns == ["id"]


class Linear:
    """A stand-in model with known effects: 3 a - 2 b, blind to c."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", 3 * F.col("a") - 2 * F.col("b"))


@pytest.fixture(scope="module")
def linear_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    return spark.createDataFrame(
        [(i, a, b, c, 3 * a - 2 * b + rng.gauss(0, 0.1)) for i, a, b, c in rows],
        "id long, a double, b double, c double, y double",
    )


def test_permutation_importance(linear_rows):
    result = models.permutation_importance(Linear(), linear_rows, F.col("id"), "y", ["a", "b", "c"])
    found = {r["feature"]: r for r in result.collect()}
    assert {r["n"] for r in found.values()} == {20}
    # Shuffling a standard normal feature of weight w adds about 2 w^2 to the error.
    assert found["a"]["importance"] == pytest.approx(3 * 2**0.5, rel=0.15)
    assert found["b"]["importance"] == pytest.approx(2 * 2**0.5, rel=0.15)
    assert found["c"]["importance"] == pytest.approx(0.0, abs=1e-12)
    assert found["a"]["p_value"] < 1e-10
    half = t_quantile(0.995, 19) * found["a"]["stddev"] / 20**0.5
    assert found["a"]["p99_high"] == pytest.approx(found["a"]["importance"] + half)
    assert found["a"]["p99_low"] == pytest.approx(found["a"]["importance"] - half)


def test_curves(linear_rows):
    curves = models.ice_curves(Linear(), linear_rows, F.col("id"), "a", quantiles=7)
    rows = curves.collect()
    assert len(rows) == 300 * 7
    observed = {r["a"]: None for r in linear_rows.collect()}
    assert {r["grid_x"] for r in rows} <= set(observed)
    effects = {r["id"]: -2 * r["b"] for r in linear_rows.collect()}
    for r in rows:
        assert r["prediction"] == pytest.approx(3 * r["grid_x"] + effects[r["instance_id"]])
    lowest = min(r["grid_x"] for r in rows)
    centred = models.ice_curves(Linear(), linear_rows, F.col("id"), "a", quantiles=7, centered=True)
    for r in centred.collect():
        assert r["prediction"] == pytest.approx(3 * (r["grid_x"] - lowest), abs=1e-9)
    pdp = models.pdp_curve(curves).collect()
    assert [r["grid_x"] for r in pdp] == sorted(r["grid_x"] for r in pdp)
    mean = sum(effects.values()) / 300
    for r in pdp:
        assert r["prediction"] == pytest.approx(3 * r["grid_x"] + mean)


def test_small_features_use_every_value(spark, linear_rows):
    rare = F.when(F.col("id") < 3, F.col("id") + 1).otherwise(0).cast("double")
    few = linear_rows.withColumn("a", rare)
    curves = models.ice_curves(Linear(), few, F.col("id"), "a", quantiles=None)
    assert {r["grid_x"] for r in curves.select("grid_x").distinct().collect()} == {0.0, 1.0, 2.0, 3.0}


def test_training_uses_the_columns(spark, linear_rows):
    rows = split.hash_split(linear_rows.withColumn("t", F.lit("x")), F.col("id"))
    scored = models.train_eval(rows, "y", {"blind": ["c"], "seeing": ["a", "b"]}, ["t"], trees=5, depth=4)
    found = {r["config"]: r for r in scored.collect()}
    assert found["seeing"]["rmse"] < 0.7 * found["blind"]["rmse"]


def test_importance_takes_all_rows_in_bounded_groups(linear_rows, monkeypatch):
    monkeypatch.setattr(models, "SHUFFLE_ROWS", 25)
    result = models.permutation_importance(Linear(), linear_rows, F.col("id"), "y", ["a", "c"])
    found = {r["feature"]: r for r in result.collect()}
    assert found["a"]["importance"] == pytest.approx(3 * 2**0.5, rel=0.15)
    assert found["c"]["importance"] == pytest.approx(0.0, abs=1e-12)


def test_models_take_any_columns(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), f"v{rng.randrange(150)}", None if i % 50 == 0 else float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, `Area(sq.mi.)` double, `a b.c` string, `y.z` double")
    model = models.train_regressor(df, "y.z", ["Area(sq.mi.)"], ["a b.c"], trees=2, depth=2)
    scored = models.predict(model, df)
    assert scored.columns == [*df.columns, "prediction"] and scored.where("prediction is null").count() == 0
    found = models.permutation_importance(model, df, F.col("id"), "y.z", ["Area(sq.mi.)"], ["a b.c"], shuffles=2)
    assert {r["feature"] for r in found.collect()} == {"Area(sq.mi.)", "a b.c"}
    curve = models.ice_curves(model, df, F.col("id"), "a b.c", quantiles=None)
    assert curve.select("grid_x").distinct().count() == df.select("`a b.c`").distinct().count()


def test_least_squares_finds_the_line(linear_rows):
    model = models.train_regressor(linear_rows, "y", ["a", "b"], linear=True)
    far = models.predict(model, linear_rows).select(F.max(F.abs(F.col("prediction") - 3 * F.col("a") + 2 * F.col("b")))).first()[0]
    assert far < 0.1


def test_lists_from_one_matrix_against_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b = rng.normal(1e6, 1), rng.normal()
        c = None if i % 7 == 0 else float("nan") if i % 11 == 0 else rng.normal() + b
        y = None if i % 50 == 0 else 2 * a - b + rng.normal() * 0.1
        rows.append((i, ["p", "q", None][i % 3], y, a, b, c, 2 * b + 3, 5.0, None))
    names = ["a", "b.b", "c", "twice", "same", "none"]
    df = spark.createDataFrame(rows, "id long, kind string, y double, a double, `b.b` double, c double, twice double, same double, none double")
    df = split.hash_split(df, F.col("id"), fraction=0.8)
    lists = gram.added_lists(["a"], names[1:], most=5)
    assert lists["added_0_skip_1"] == ["a"] and lists["added_2_skip_1"] == ["a", "c", "twice"] and "added_5_skip_1" not in lists
    found = {(r["kind"], r["config"]): r for r in gram.train_eval_lists(df, "y", lists, ["kind"]).collect()}
    assert len(found) == 2 * len(lists)
    part = df.toPandas()
    for (kind, config), r in found.items():
        own = part[(part.kind == kind) & part.y.notna()]
        train, test = own[own.split == "train"], own[own.split == "test"]
        mean = train[lists[config]].astype(float).mean().fillna(0.0)
        x, z = (v[lists[config]].astype(float).fillna(mean).to_numpy() - mean.to_numpy() for v in (train, test))
        slopes = np.linalg.lstsq(x, train.y - train.y.mean(), rcond=1e-9)[0]
        e = test.y.to_numpy() - train.y.mean() - z @ slopes
        assert r["n"] == len(e) and r["rmse"] == pytest.approx(np.sqrt((e**2).mean()), rel=1e-6), (kind, config)
    assert gram.train_eval_lists(df.limit(0), "y", lists, ["kind"]).count() == 0
    with pytest.raises(ValueError, match="grouping column"):
        gram.train_eval_lists(df, "y", lists, [])
