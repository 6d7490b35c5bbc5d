"""Quality of searches and of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekin.functions.hashing import sign_label, term
from lakekin.functions.stats import pearson
from lakekin.operators.sketch import pair_sketch
from lakekin.options import PAIR, SketchOptions
from lakekin.session import materialize


#: Rows of a group that one task may order at the end of an exact selection.
BAND_ROWS = 100_000
#: Bins of a histogram that draws a bracket in.
BINS = 4096


def search_quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of two id lists, compared as sets of pairs."""
    return grouped_quality(truth, found, [])


def grouped_quality(truth: DataFrame, found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """:func:`search_quality` of several result lists against one truth."""
    truth_ids = truth.select(*PAIR).distinct()
    found_ids = found.select(*groups, *PAIR).distinct()
    marked = found_ids.join(truth_ids.withColumn("is_true", F.lit(1)), PAIR, "left")
    counts = marked.groupBy(*groups).agg(
        F.count("*").alias("n_found"), F.count("is_true").alias("n_common")
    )
    n_truth = truth_ids.agg(F.count("*")).scalar()
    scored = counts.withColumn("n_truth", n_truth).withColumn(
        "precision", F.coalesce(F.try_divide("n_common", "n_found"), F.lit(0.0))
    ).withColumn("recall", F.coalesce(F.try_divide("n_common", "n_truth"), F.lit(0.0)))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def grid_counts(
    means: DataFrame,
    query: DataFrame,
    index_sizes: Sequence[int],
    query_sizes: Sequence[int],
    opts: SketchOptions = SketchOptions(),
) -> DataFrame:
    """Match counts for every combination of index and query sketch size, in one plan.

    Sketches nest: the sample of a smaller size is the head of a larger one.
    One sketch of the largest size therefore serves all sizes; only the mean
    and the labels are made per size.
    """

    def sized(pairs: DataFrame, sizes: Sequence[int], name: str) -> DataFrame:
        largest = SketchOptions(**{**opts.__dict__, "size": max(sizes)})
        sketch = pair_sketch(pairs, largest)
        nested = sketch.select(
            "*", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)])).alias(name)
        ).where(F.col("sketch_rank") <= F.col(name))
        return nested.withColumn(
            "mean", F.avg("value").over(Window.partitionBy(*PAIR, name))
        )

    value, mean = F.col("value"), F.col("mean")
    index = sized(means, index_sizes, "index_size").select(
        "index_size", *PAIR, term(F.col("key"), sign_label(value, mean, opts), opts).alias("term")
    )
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                term(F.col("key"), sign_label(value, mean, opts, negate=side == "-"), opts).alias("term"),
            )
            for side in ("+", "-")
        ]
    )
    probe = (
        sized(query, query_sizes, "query_size")
        .select("query_size", F.explode(sides).alias("s"))
        .select("query_size", "s.side", "s.term")
        .distinct()
    )
    # At most two terms per key of the largest sketch and query size.
    hits = index.join(F.broadcast(probe), "term")
    return hits.groupBy("index_size", "query_size", *PAIR, "side").agg(F.count("*").alias("matches"))


def quality_grid(
    means: DataFrame,
    query: DataFrame,
    truth: DataFrame,
    k: int,
    sizes: Sequence[int] = (512, 128, 32),
    opts: SketchOptions = SketchOptions(),
) -> DataFrame:
    """Precision, recall and F1 of the top k for each pair of sketch sizes."""
    counts = grid_counts(means, query, sizes, sizes, opts)
    order = Window.partitionBy("index_size", "query_size").orderBy(
        F.desc("matches"), *PAIR, "side"
    )
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return grouped_quality(truth, top, ["index_size", "query_size"])


def _narrower(df: DataFrame, value: str, groups: Sequence[str], bracket: DataFrame) -> DataFrame:
    """``bracket`` drawn in to the bins, of equal width, that hold the median of their group."""
    marked = df.where(F.col(value).isNotNull()).join(bracket, list(groups))
    v, low, high = F.col(value), F.col("b")[0], F.col("b")[1]
    place = F.floor(F.try_divide(v - low, high - low) * BINS)
    inside = F.least(F.coalesce(place, F.lit(0)), F.lit(BINS - 1))
    bin_of = F.when(v < low, -1).when(v > high, BINS).otherwise(inside)
    bins = marked.groupBy(*groups, "n", bin_of.alias("bin")).agg(
        F.count("*").alias("times"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    # At most BINS + 2 rows per group.
    last = F.sum("times").over(Window.partitionBy(*groups).orderBy("bin"))
    held = bins.withColumn("last", last).where(
        (F.col("last") > F.floor((F.col("n") - 1) / 2)) & (F.col("last") - F.col("times") <= F.floor(F.col("n") / 2))
    )
    return held.groupBy(*groups, "n").agg(F.array(F.min("least"), F.max("most")).alias("b"))


def exact_median(df: DataFrame, value: str, groups: Sequence[str], *, band_rows: int = BAND_ROWS) -> DataFrame:
    """Exact median per group without gathering a group in one buffer.

    An approximate percentile gives a bracket that is sure to hold the median.
    While a bracket holds more than ``band_rows`` rows of different values, a histogram
    of what is in it draws it in, for all groups in one pass. What is left is ordered,
    next to the count of values below.
    """
    if not groups:
        raise ValueError("name at least one grouping column")
    accuracy = 10_000
    slack = 2.0 / accuracy
    bracket = df.groupBy(*groups).agg(
        F.percentile_approx(value, [0.5 - slack, 0.5 + slack], accuracy).alias("b"),
        F.count(value).alias("n"),
    )
    bracket = materialize(bracket.select(*groups, F.col("b").cast("array<double>").alias("b"), "n"), "brackets")
    before = None
    while True:
        within = (F.col(value) >= F.col("b")[0]) & (F.col(value) <= F.col("b")[1]) & (F.col("b")[0] < F.col("b")[1])
        held = df.join(bracket, list(groups)).where(within).groupBy(*groups).agg(F.count("*").alias("held"))
        # Every pass draws an overfull bracket in, unless its width is no finite number.
        largest = held.agg(F.max("held").alias("largest"), F.sum("held").alias("all")).first()
        if (largest["largest"] or 0) <= band_rows or largest["all"] == before:
            break
        before = largest["all"]
        bracket = materialize(_narrower(df, value, groups, bracket), "brackets")
    # One bracket row per group, that is per model configuration.
    marked = df.join(bracket, list(groups))
    v, low, high = F.col(value), F.col("b")[0], F.col("b")[1]
    below = marked.groupBy(*groups, "n").agg(F.count_if(v < low).alias("n_below"))
    inside = marked.where((v >= low) & (v <= high)).groupBy(*groups, v.alias("v")).agg(
        F.count("*").alias("times")
    )
    running = F.sum("times").over(Window.partitionBy(*groups).orderBy("v"))
    placed = inside.withColumn("upto", running).join(below, list(groups))
    first = F.col("n_below") + F.col("upto") - F.col("times")
    last = F.col("n_below") + F.col("upto")
    left = F.floor((F.col("n") - 1) / 2)
    right = F.floor(F.col("n") / 2)
    return placed.groupBy(*groups).agg(
        (
            (
                F.max(F.when((first <= left) & (left < last), F.col("v")))
                + F.max(F.when((first <= right) & (right < last), F.col("v")))
            )
            / 2
        ).alias("median")
    )


def regression_metrics(
    predictions: DataFrame, label: str, prediction: str, groups: Sequence[str] = ("config",)
) -> DataFrame:
    """RMSE, MSE, MAE, R2, Pearson r and median absolute error per configuration.

    Label and prediction are written once: the median takes further passes,
    which must not run the model again.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    base = predictions.select(*groups, y.alias("y"), p.alias("p")).where(
        F.col("y").isNotNull() & F.col("p").isNotNull()
    )
    base = materialize(base, "predictions")
    e = F.col("y") - F.col("p")
    summary = base.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        pearson(F.col("y"), F.col("p")).alias("pearson"),
    )
    errors = base.select(*groups, F.abs(e).alias("abs_error"))
    medians = exact_median(errors, "abs_error", groups).withColumnRenamed("median", "median_ae")
    return summary.join(medians, list(groups))
