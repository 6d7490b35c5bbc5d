"""Join discovered columns back onto the query table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.operators.pairs import LakeTable, lake_means, quoted, restrict
from lakekin.options import PAIR


def augment_mean(
    base: DataFrame, base_key: str, new: DataFrame, new_key: str, measure: str, name: str
) -> DataFrame:
    """Left join the per-key mean of one measure; base rows and their number stay."""
    means = (
        new.where(quoted(new_key).isNotNull())
        .groupBy(quoted(new_key).alias("_key"))
        .agg(F.avg(quoted(measure).cast("double")).alias(name))
    )
    return base.join(means, quoted(base_key) == F.col("_key"), "left").drop("_key")


def group_base(df: DataFrame, key: str, measures: Sequence[str], label: str | None = None) -> DataFrame:
    """One row per key by the mean of the measures; keys without a label drop out."""
    grouped = df.groupBy(quoted(key)).agg(*[F.avg(quoted(m)).alias(m) for m in measures])
    return grouped.where(quoted(label).isNotNull()) if label else grouped


def ranked_hits(hits: DataFrame, measure_order: str, k: int) -> DataFrame:
    """Distinct pairs of a search result numbered 1..k by descending ``measure_order``.

    ``hits`` is a top-k result, so numbering it needs no more than k rows.
    """
    best = (
        hits.groupBy(*PAIR)
        .agg(F.max(measure_order).alias("strength"))
        .orderBy(F.desc("strength"), *PAIR)
        .limit(k)
    )
    listed = best.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), *PAIR))).alias("hits")
    )
    return listed.select(F.posexplode("hits").alias("place", "h")).select(
        (F.col("place") + 1).alias("place"), *[F.col(f"h.{c}").alias(c) for c in PAIR]
    )


def hit_columns(lake: Sequence[LakeTable], hits: DataFrame, k: int) -> DataFrame:
    """One row per key with columns ``hit_1 .. hit_k`` holding the means of the hits.

    The k hits are read to the driver to name the tables and columns they
    need; nothing else of the lake is touched.
    """
    named = hits.where(F.col("place") <= k).select("place", *PAIR).limit(k).collect()
    pairs = [(r["table_id"], r["key_col"], r["value_col"]) for r in named]
    means = lake_means(restrict(lake, pairs) or list(lake[:1]))
    places = list(range(1, k + 1))
    listed = hits.sparkSession.createDataFrame(
        [tuple(r) for r in named], "place int, table_id string, key_col string, value_col string"
    )
    chosen = means.join(F.broadcast(listed), PAIR)
    wide = chosen.groupBy("key").pivot("place", places).agg(F.first("value"))
    return wide.select("key", *[quoted(str(p)).alias(f"hit_{p}") for p in places])


def augment_hits(
    base: DataFrame,
    base_key: str,
    lake: Sequence[LakeTable],
    hits: DataFrame,
    k: int,
    skip_first: int = 0,
) -> DataFrame:
    """Left join the columns of the first k hits, leaving out the first ``skip_first``."""
    wide = hit_columns(lake, hits, k).withColumnRenamed("key", "_key")
    wide = wide.drop(*[f"hit_{p}" for p in range(1, skip_first + 1)])
    return base.join(wide, quoted(base_key) == F.col("_key"), "left").drop("_key")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Remove the query key or a leaking column before training."""
    return df.drop(*names)
