"""Does an added column help? Regression models, permutation importance, ICE and PDP."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.functions.stats import one_sided_p, t_quantile
from lakekin.operators.evaluate import regression_metrics
from lakekin.operators.pairs import quoted
from lakekin.options import IMPORTANCE_SHUFFLES

#: Rows, about, among which a shuffled feature changes places.
SHUFFLE_ROWS = 4096


@dataclass(frozen=True)
class FittedModel:
    """A fitted pipeline and the columns it reads, whatever their names are."""

    pipeline: PipelineModel
    numbers: tuple[str, ...]
    texts: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        inside = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *_inputs(self.numbers, self.texts))
        scored = self.pipeline.transform(inside).select("row.*", "prediction")
        return scored


def _inputs(numbers: Sequence[str], texts: Sequence[str]) -> list[Column]:
    """The features under names of our own; a header may hold dots or anything else."""
    return [
        *[quoted(n).cast("double").alias(f"number_{i}") for i, n in enumerate(numbers)],
        *[quoted(t).cast("string").alias(f"text_{i}") for i, t in enumerate(texts)],
    ]


def train_regressor(
    train: DataFrame,
    label: str,
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    *,
    linear: bool = False,
    trees: int = 20,
    depth: int = 4,
    seed: int = 0,
) -> FittedModel:
    """Gradient boosted trees (or least squares) on imputed numbers and coded texts.

    Rows without a label are left out. A text is coded by how frequent its value
    is, as a plain number, so a column may have any number of values.
    """
    numbers, texts = tuple(numbers), tuple(texts)
    typed = train.select(quoted(label).cast("double").alias("label"), *_inputs(numbers, texts))
    typed = typed.where(F.col("label").isNotNull() & ~F.isnan("label"))
    stages, features = [], []
    if numbers:
        features += [f"number_{i}_filled" for i in range(len(numbers))]
        stages.append(Imputer(inputCols=[f"number_{i}" for i in range(len(numbers))], outputCols=features[:]))
    if texts:
        coded = [f"text_{i}_code" for i in range(len(texts))]
        stages.append(
            StringIndexer(inputCols=[f"text_{i}" for i in range(len(texts))], outputCols=coded, handleInvalid="keep")
        )
        # The sum drops the mark of a nominal column, which would limit its values.
        plain = ", ".join(f"{c} + 0.0 AS {c}_plain" for c in coded)
        stages.append(SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"))
        features += [f"{c}_plain" for c in coded]
    stages.append(VectorAssembler(inputCols=features, outputCol="features"))
    if linear:
        stages.append(LinearRegression(labelCol="label", solver="normal", regParam=0.0))
    else:
        stages.append(GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=seed))
    return FittedModel(Pipeline(stages=stages).fit(typed), numbers, texts)


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; the model's helper columns are dropped."""
    return model.transform(df).select(*[quoted(c) for c in df.columns], "prediction")


def train_eval(
    split: DataFrame,
    label: str,
    configurations: dict[str, Sequence[str]],
    texts: Sequence[str] = (),
    **training,
) -> DataFrame:
    """Train one model per configuration (a list of number columns) and score it on the test rows."""
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    scored = []
    for name, numbers in configurations.items():
        model = train_regressor(train, label, numbers, texts, **training)
        scored.append(
            predict(model, test).select(
                F.lit(name).alias("config"), quoted(label).alias("label"), "prediction"
            )
        )
    union = scored[0]
    for part in scored[1:]:
        union = union.unionByName(part)
    return regression_metrics(union, "label", "prediction")


def permutation_importance(
    model,
    df: DataFrame,
    row_key: Column,
    label: str,
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    *,
    max_rows: int | None = None,
    shuffles: int = IMPORTANCE_SHUFFLES,
    seed: int = 0,
) -> DataFrame:
    """Rise of the RMSE when one feature is shuffled: mean, deviation, p value, 99 % interval.

    Text features are shuffled like numbers. All rows with a label take part;
    ``max_rows`` asks for a sample picked by hash. In a shuffle, rows are dealt
    at random into groups of about :data:`SHUFFLE_ROWS`; in a random order of
    its group each row takes the value of the next and the last that of the
    first. All (feature, shuffle) variants are scored by one ``transform``.
    """

    def shuffled_by(*parts: Column | str) -> Column:
        return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))

    base = df.select(row_key.cast("string").alias("row_key"), *[quoted(c) for c in df.columns])
    base = base.where(quoted(label).isNotNull())
    if max_rows is not None:
        base = base.orderBy(shuffled_by("row_key"), "row_key").limit(max_rows)
    groups = max(1, -(-base.count() // SHUFFLE_ROWS))
    names = [*numbers, *texts]
    variants = F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("round")
    rows = base.select("*", variants).select("*", rounds)
    place = shuffled_by("row_key", "feature", F.col("round").cast("string"))
    group = F.pmod(F.conv(F.substring(place, 1, 8), 16, 10).cast("long"), F.lit(groups))
    rows = rows.withColumns({"shuffle_place": place, "shuffle_group": group})
    line = Window.partitionBy("feature", "round", "shuffle_group").orderBy("shuffle_place", "row_key")

    def donated(name: str) -> Column:
        after = F.lead(quoted(name)).over(line)
        last = F.lead(F.lit(1)).over(line).isNull()
        other = F.when(last, F.first(quoted(name)).over(line)).otherwise(after)
        return F.when(F.col("feature") == name, other).otherwise(quoted(name))

    shuffled = rows.select(
        "feature", "round", *[donated(c).alias(c) if c in names else quoted(c) for c in df.columns]
    )
    error = F.col("prediction") - quoted(label)
    rmse = F.sqrt(F.avg(error * error))
    plain = predict(model, base).agg(rmse.alias("rmse")).scalar()
    per_round = (
        model.transform(shuffled)
        .groupBy("feature", "round")
        .agg(rmse.alias("rmse"))
        .withColumn("drop", F.col("rmse") - plain)
    )
    summary = per_round.groupBy("feature").agg(
        F.avg("drop").alias("importance"),
        F.stddev_samp("drop").alias("stddev"),
        F.count("*").alias("n"),
    )
    spread = F.col("stddev") / F.sqrt("n")
    half = F.lit(t_quantile(0.995, shuffles - 1)) * spread
    return summary.withColumn(
        "p_value",
        one_sided_p(F.try_divide(F.col("importance"), spread), (F.col("n") - 1).cast("double")),
    ).select(
        "feature",
        "importance",
        "stddev",
        "p_value",
        "n",
        (F.col("importance") + half).alias("p99_high"),
        (F.col("importance") - half).alias("p99_low"),
    )


def feature_grid(df: DataFrame, feature: str, quantiles: int | None = None) -> Column:
    """Scalar array of observed values of a feature, ascending.

    Every distinct value, or, when ``quantiles`` asks for a number of points,
    evenly spaced percentiles (rare values are then not all among them).
    """
    value = quoted(feature)
    if quantiles is None:
        return df.agg(F.array_sort(F.collect_set(value))).scalar()
    shares = [i / (quantiles - 1) for i in range(quantiles)] if quantiles > 1 else [0.5]
    found = F.percentile_approx(value.cast("double"), shares, 10_000)
    return df.agg(F.array_sort(F.array_distinct(found))).scalar()


def ice_curves(
    model,
    df: DataFrame,
    row_key: Column,
    feature: str,
    *,
    quantiles: int | None = 20,
    centered: bool = False,
) -> DataFrame:
    """Prediction of every row at every grid value of one feature, number or text.

    ``(instance_id, grid_x, prediction)``; ``centered`` subtracts the
    prediction at the smallest grid value of the instance. ``quantiles=None``
    takes every distinct value.
    """
    expanded = df.select(
        row_key.alias("instance_id"),
        *[quoted(c) for c in df.columns if c != feature],
        F.explode(feature_grid(df, feature, quantiles)).alias(feature),
    )
    curves = model.transform(expanded).select(
        "instance_id", quoted(feature).alias("grid_x"), "prediction"
    )
    if centered:
        # One instance has as many rows as the grid has values.
        line = Window.partitionBy("instance_id").orderBy("grid_x")
        curves = curves.withColumn(
            "prediction", F.col("prediction") - F.first("prediction").over(line)
        )
    return curves


def pdp_curve(curves: DataFrame) -> DataFrame:
    """Mean prediction per grid value, sorted by it."""
    return (
        curves.groupBy("grid_x").agg(F.avg("prediction").alias("prediction")).orderBy("grid_x")
    )
