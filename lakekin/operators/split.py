"""Repeatable train/test splits without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekin.operators.evaluate import BAND_ROWS
from lakekin.options import TRAIN_FRACTION

BUCKET_DIGITS = 4


def _split_hash(row_key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_key.cast("string")).cast("binary"))


def hash_split(
    df: DataFrame, row_key: Column, seed: int = 0, fraction: float = TRAIN_FRACTION
) -> DataFrame:
    """Add ``split``: ``train`` for about ``fraction`` of the rows, by a hash of the row key.

    A row keeps its side whatever else is in the table.
    """
    cut = format(int(fraction * 16**8), "08x")
    train = F.substring(_split_hash(row_key, seed), 1, 8) < F.lit(cut)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def exact_split(
    df: DataFrame, row_key: Column, seed: int = 0, fraction: float = TRAIN_FRACTION, *, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Like :func:`hash_split` with exactly ``floor(fraction * n)`` training rows.

    Rows are counted per hash prefix (at most 16^4 counts), then within the prefix that
    holds the cut per longer prefix, until at most ``band_rows`` rows share it; only
    these are ranked. ``row_key`` must be unique.
    """
    hashed = df.withColumn("_hash", _split_hash(row_key, seed))
    cut, take, digits, rows = "", None, 0, None
    while digits < 32 and (rows is None or rows > band_rows):
        digits += BUCKET_DIGITS
        counts = hashed.where(F.col("_hash").startswith(cut)).groupBy(F.substring("_hash", 1, digits).alias("prefix"))
        # One row per prefix: a window over all of them is bounded.
        running = counts.agg(F.count("*").alias("n")).select(
            "prefix",
            "n",
            F.sum("n").over(Window.orderBy("prefix")).alias("end"),
            F.sum("n").over(Window.partitionBy()).alias("total"),
        )
        want = F.floor(F.col("total") * F.lit(fraction)) if take is None else F.lit(take)
        found = (
            running.where(F.col("end") >= want)
            .agg(F.min(F.struct("prefix", (want - F.col("end") + F.col("n")).alias("take"), "n")).alias("c"))
            .first()["c"]
        )
        if found is None:
            return hashed.withColumn("split", F.lit("test")).drop("_hash")
        cut, take, rows = found["prefix"], found["take"], found["n"]
    prefix = F.substring("_hash", 1, digits)
    ranked = (
        hashed.where(prefix == cut)
        .withColumn("_rank", F.row_number().over(Window.orderBy("_hash")))
        .withColumn("split", F.when(F.col("_rank") <= take, "train").otherwise("test"))
        .drop("_rank")
    )
    others = hashed.where(prefix != cut).withColumn("split", F.when(prefix < cut, "train").otherwise("test"))
    return ranked.unionByName(others).drop("_hash")


def save_split(df: DataFrame, path: str) -> None:
    """Store a split table; the side is a directory level."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a stored split."""
    stored = spark.read.parquet(path)
    return (
        stored.where(F.col("split") == "train").drop("split"),
        stored.where(F.col("split") == "test").drop("split"),
    )
