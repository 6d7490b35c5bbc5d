"""Session helpers: recommended settings, shared scratch folder, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the plans are written for. The IN threshold lets the few hundred
#: terms of one query reach the Parquet page index as exact values.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.pushdown.inFilterThreshold": "2048",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`RECOMMENDED` to a session builder."""
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return builder


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local runs, tests) a temporary folder is
    made and remembered for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="lakekin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several jobs: the lineage is cut by files that
    outlive any executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of ``schema``, made without a Python task."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")


def fits(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` is proven to be at most ``max_rows`` and ``max_bytes``.

    The probe reads no more than ``max_rows + 1`` rows.
    """
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(1)) for c in df.columns),
        F.lit(8),
    )
    probe = df.select(width.alias("w")).limit(max_rows + 1)
    row = probe.agg(F.count("*").alias("n"), F.sum("w").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes
