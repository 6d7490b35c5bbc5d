"""Gapless row numbers within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.session import materialize


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``pos``, from 0 in ``order`` within ``group``, and ``n``, the group's rows.

    ``group`` holds no nulls. Rows are dealt into sorted ranges, so a group of any
    size spreads over many tasks; repeated rows are told apart by where they were
    read, so that they can be split too. The ranges are written once. One row per
    (range, group) then says where a group's rows in that range begin.

    ``rows`` is read twice (range bounds, then rows): pass a written table.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(group).asc(), *order, F.col("__tie").asc()]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    # The upper bits of the id are the partition, the lower 33 the row in it.
    parts = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    parts = parts.withColumn("__part", F.shiftright("__at", 33))
    counts = parts.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    of_group = Window.partitionBy(group)
    before = F.sum("__rows").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        "__part",
        group,
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(of_group).alias("n"),
    )
    joined = parts.join(starts, ["__part", group])
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")
