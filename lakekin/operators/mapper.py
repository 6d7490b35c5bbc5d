"""Run a user's pandas function over every table of a lake."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekin.operators.profile import column_label


def _wide(cells: pd.DataFrame) -> pd.DataFrame:
    """The pandas table of a block of cells; columns that are all numbers become float."""
    rows, line = np.unique(cells["row_id"].to_numpy(), return_inverse=True)
    positions, first, column = np.unique(cells["column_id"].to_numpy(), return_index=True, return_inverse=True)
    place = line * len(positions) + column
    if len(np.unique(place)) < len(place):
        raise ValueError("Index contains duplicate entries, cannot reshape")
    text = np.full(len(rows) * len(positions), None, dtype=object)
    text[place] = cells["cell"].to_numpy()
    numbers = np.full(len(rows) * len(positions), np.nan)
    numbers[place] = cells["num"].to_numpy(dtype=float, na_value=np.nan)
    text, numbers = text.reshape(-1, len(positions)), numbers.reshape(-1, len(positions))
    index = pd.Index(rows, name="row_id")
    columns = {}
    for n, position in enumerate(positions):
        numeric = ~np.isnan(numbers[:, n]).any()
        if not numeric:
            numeric = (~np.isnan(numbers[:, n]) | pd.isna(text[:, n])).all()
        values = numbers[:, n] if numeric else text[:, n]
        columns[position] = pd.Series(values, index=index, dtype=float if numeric else object)
    frame = pd.DataFrame(columns)
    # Headers are set last: equal ones are columns of their own.
    frame.columns = list(cells["label"].iloc[first])
    frame.columns.name = str(cells["table_id"].iloc[0])
    return frame


def _raw(blocks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Output rows of every block, or one row with ``error`` set."""
    output = T.StructType.fromDDL(schema)
    raw_schema = T.StructType(
        [T.StructField("table_id", T.StringType()), *output.fields, T.StructField("error", T.StringType())]
    )
    names = [f.name for f in output.fields]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            result = function(_wide(pdf)).reset_index(drop=True)[names]
            return result.assign(table_id=key[0], error=None)[["table_id", *names, "error"]]
        except Exception as problem:
            row = {"table_id": key[0], **{n: None for n in names}}
            return pd.DataFrame([{**row, "error": f"{type(problem).__name__}: {problem}"}])

    return blocks.groupBy("table_id", "block").applyInPandas(run, raw_schema)


def _run(
    blocks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> tuple[DataFrame, DataFrame]:
    raw = _raw(blocks, function, schema)
    errors = raw.where(F.col("error").isNotNull()).select("table_id", "error")
    return raw.where(F.col("error").isNull()).drop("error"), errors


def _blocks(cells: DataFrame, block: Column) -> DataFrame:
    label = column_label(F.col("column_id"), F.col("column_name")).alias("label")
    return cells.select("table_id", block.alias("block"), "row_id", "column_id", label, "cell", "num")


def map_tables(
    cells: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> tuple[DataFrame, DataFrame]:
    """``(results, errors)`` of ``function`` applied to each table as a whole.

    One task holds one table, whatever its size; for tables that no task can
    hold there is :func:`map_blocks`. ``results`` has ``table_id`` and the
    columns of ``schema``; ``errors`` the tables on which the function raised.
    """
    return _run(_blocks(cells, F.lit(0)), function, schema)


def map_blocks(
    cells: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    combine: Sequence[Column],
    *,
    block_rows: int = 50_000,
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`map_tables`, but every table comes in blocks of rows.

    ``combine`` (aggregates over the output columns, by table) merges the block
    results. A table of which any block failed is among the errors only.
    """
    raw = _raw(_blocks(cells, F.expr(f"row_id DIV {int(block_rows)}")), function, schema)
    # One pass: the function runs once per block, whether its table fails or not.
    merged = raw.groupBy("table_id").agg(*combine, F.min("error").alias("__error"))
    failed = merged.where(F.col("__error").isNotNull()).select("table_id", F.col("__error").alias("error"))
    return merged.where(F.col("__error").isNull()).drop("__error"), failed
