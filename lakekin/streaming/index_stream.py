"""Grow a stored index from a stream of arriving files.

Every file is a whole table, so no state is kept between batches. Batch ids
come from the stream's checkpoint: a batch that is repeated after a failure
overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakekin.operators.index_store import TermStore
from lakekin.sources.cells import CellSource
from lakekin.sources.files import csv_cells


def stream_files(spark: SparkSession, path: str, pattern: str = "*.csv", per_batch: int = 1000) -> DataFrame:
    """Arriving files as ``(path, content)``."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch)
        .load(path)
        .select("path", "content")
    )


def index_stream(
    files: DataFrame,
    store: TermStore,
    checkpoint: str,
    *,
    decode: Callable[[DataFrame], CellSource] = csv_cells,
    trigger: dict | None = None,
    **rules,
) -> StreamingQuery:
    """Start indexing ``files``; by default everything present, then stop.

    ``rules`` are the column rules of ``cell_pair_means``.
    """

    def grow(batch: DataFrame, batch_id: int) -> None:
        store.append_cells(decode(batch).cells, f"stream-{batch_id}", stage=True, **rules)

    return (
        files.writeStream.foreachBatch(grow)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
