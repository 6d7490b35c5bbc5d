"""The tall form of a lake: one row per cell."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekin.functions.numeric import clean_text, parse_number
from lakekin.operators.pairs import quoted

CELL_SCHEMA = (
    "table_id string, row_id bigint, column_id int, column_name string, cell string, num double"
)
CELL_COLUMNS = ["table_id", "row_id", "column_id", "column_name", "cell", "num"]

#: What decoders hand to Spark: text cells, or one row with ``error`` set.
RAW_SCHEMA = (
    "table_id string, row_id bigint, column_id int, column_name string, cell string, error string"
)


class CellSource(NamedTuple):
    """Cells of the readable tables, and ``(table_id, error)`` of the others."""

    cells: DataFrame
    errors: DataFrame


def split_errors(raw: DataFrame) -> CellSource:
    """Separate decoded cells from error rows; numbers are parsed here, once."""
    cells = raw.where(F.col("error").isNull()).withColumn("num", parse_number(F.col("cell")))
    errors = raw.where(F.col("error").isNotNull()).select("table_id", "error")
    return CellSource(cells.select(*CELL_COLUMNS), errors)


def cells_from_wide(
    df: DataFrame, table_id: str, row_id: Column | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Cells of a wide table.

    ``row_id`` is a unique integer key when results have to repeat between
    runs; without it rows are numbered as they are read.
    """
    row_id = F.monotonically_increasing_id() if row_id is None else row_id.cast("long")
    chosen = list(columns) if columns else df.columns
    cells = []
    for position, name in enumerate(chosen):
        kind = df.schema[name].dataType
        text = quoted(name).cast("string")
        number = quoted(name).cast("double") if isinstance(kind, T.NumericType) else parse_number(text)
        cells.append(
            F.struct(
                F.lit(position).alias("column_id"),
                F.lit(name).alias("column_name"),
                text.alias("cell"),
                number.alias("num"),
            )
        )
    exploded = df.select(row_id.alias("row_id"), F.inline(F.array(*cells)))
    return exploded.select(F.lit(table_id).alias("table_id"), *CELL_COLUMNS[1:])


def union_cells(parts: Iterable[DataFrame]) -> DataFrame:
    """All given parts of a lake."""
    return reduce(DataFrame.unionByName, parts)


def clean_cells(cells: DataFrame) -> DataFrame:
    """Strip and lower-case text cells; numbers keep their text."""
    return cells.withColumn(
        "cell", F.when(F.col("num").isNull(), clean_text(F.col("cell"))).otherwise(F.col("cell"))
    )


def select_tables(cells: DataFrame, table_ids: Sequence[str]) -> DataFrame:
    """Cells of the named tables; the filter reaches the scan of stored cells."""
    return cells.where(F.col("table_id").isin(list(table_ids)))


def rebuild_table(cells: DataFrame, table_id: str, n_columns: int) -> DataFrame:
    """The wide table behind ``table_id``; columns are named by position."""
    positions = list(range(n_columns))
    return (
        select_tables(cells, [table_id])
        .groupBy("row_id")
        .pivot("column_id", positions)
        .agg(F.first("cell"))
    )


def save_cells(cells: DataFrame, path: str) -> None:
    """Store cells clustered by table, so that table filters skip files."""
    cells.repartitionByRange("table_id", "row_id").sortWithinPartitions(
        "table_id", "row_id", "column_id"
    ).write.mode("overwrite").parquet(path)


def load_cells(spark, path: str) -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).parquet(path)
