"""A stored index whose tables may grow: sketches that merge.

A batch is reduced, per pair, to the sum and count of the measure for the keys with the
smallest hashes, and to counters per column. Both merge exactly. A key among the ``k``
smallest of a whole table is among the ``k`` smallest of every part that holds it, so
no part has dropped it or any of its rows; and a column is a key or measure column of
the whole table only if it is one in every part. So the index of a table that arrived
in any number of batches equals the index of the table in one piece. A table row must
arrive in one batch.

Batches, commits and repeats are those of :class:`TermStore`: writing a batch again
replaces that batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.operators.index_store import TermStore
from lakekin.operators.pairs import LakeTable, cell_pair_aggregate
from lakekin.operators.profile import column_label, column_profile, role_of
from lakekin.operators.sketch import pair_sketch, sketch_terms
from lakekin.options import PAIR
from lakekin.session import empty_frame, materialize

SKETCH_SCHEMA = "table_id string, key_col string, value_col string, key string, total double, n bigint"
PROFILE_SCHEMA = (
    "table_id string, label string, column_id int, n_cells bigint, n_numbers bigint, n_missing bigint"
)


def sums_of_value() -> list[Column]:
    return [F.sum("value").alias("total"), F.count("value").alias("n")]


class SketchStore(TermStore):
    """One stored index of growing tables.

    Column roles follow the strict rule; they and ``min_rows`` are decided on the merged
    counters, when the index is read.
    """

    PARTS = ("sketches", "profiles")

    def __init__(self, spark, path, opts, *, null_as_nan: bool = True, min_rows: int = 2) -> None:
        super().__init__(spark, path, opts)
        self.rules = {"rule": "strict", "null_as_nan": null_as_nan}
        self.min_rows = min_rows

    def _stored(self, part: str, schema: str) -> DataFrame:
        found = list(self.attempts().values())
        if not found:
            return empty_frame(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/attempt={a}" for a in found])

    def tables(self) -> DataFrame:
        """``table_id, batch`` has no meaning for tables of several batches; the ids are listed once."""
        return self._stored("profiles", PROFILE_SCHEMA).select("table_id").distinct()

    def append(self, means: DataFrame, batch: str) -> None:
        raise TypeError("means do not merge; append rows or cells")

    def append_tables(self, lake: Sequence[LakeTable], batch: str, *, two_pass: bool = False) -> None:
        raise TypeError("append rows or cells")

    def append_rows(self, rows: DataFrame, batch: str) -> None:
        """Further ``(pair, key, value)`` rows of tables whose column roles are declared.

        Their columns get no counters and so pass every rule.
        """
        self._write_parts(self._part(rows), empty_frame(self.spark, PROFILE_SCHEMA), batch)

    def append_sums(self, sums: DataFrame, batch: str) -> None:
        """Like :meth:`append_rows`, for rows ``(pair, key, total, n)`` that are summed already."""
        merged = sums.groupBy(*PAIR, "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        self._write_parts(self._smallest(merged.where("n > 0")), empty_frame(self.spark, PROFILE_SCHEMA), batch)

    def append_cells(self, cells: DataFrame, batch: str, *, stage: bool = False, label_by: str = "name", **rules) -> None:
        """Further cells of new or known tables; ``rules`` are given to the store instead."""
        if rules:
            raise TypeError(f"the store decides on {sorted(rules)}")
        if stage:
            cells = materialize(cells, "cells")
        label = column_label(F.col("column_id"), F.col("column_name"), label_by).alias("label")
        # Written once: the counters are stored and decide on the roles.
        found = materialize(column_profile(cells, **self.rules), "profile")
        profiles = found.select("table_id", label, "column_id", "n_cells", "n_numbers", "n_missing")
        sums = cell_pair_aggregate(cells, *sums_of_value(), **self.rules, min_rows=1, label_by=label_by, profile=found)
        self._write_parts(self._smallest(sums.where("n > 0")), profiles, batch)

    def _part(self, rows: DataFrame) -> DataFrame:
        return self._smallest(rows.groupBy(*PAIR, "key").agg(*sums_of_value()).where("n > 0"))

    def _smallest(self, sums: DataFrame) -> DataFrame:
        kept = pair_sketch(sums.select(*PAIR, "key", F.struct("total", "n").alias("value")), self.opts)
        return kept.select(*PAIR, "key", "value.total", "value.n")

    def _write_parts(self, sketches: DataFrame, profiles: DataFrame, batch: str, *, alone: bool = False) -> None:
        attempt = uuid.uuid4().hex
        sketches.repartitionByRange(*PAIR, "key").write.parquet(f"{self.path}/sketches/attempt={attempt}")
        profiles.write.parquet(f"{self.path}/profiles/attempt={attempt}")
        self._commit(attempt, batch, alone)

    def merged_sums(self) -> DataFrame:
        """Sum and count per pair and key over all batches; exact for the smallest keys."""
        stored = self._stored("sketches", SKETCH_SCHEMA)
        return stored.groupBy(*PAIR, "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    def merged_profiles(self) -> DataFrame:
        stored = self._stored("profiles", PROFILE_SCHEMA)
        counters = ("n_cells", "n_numbers", "n_missing")
        return stored.groupBy("table_id", "label", "column_id").agg(*[F.sum(c).alias(c) for c in counters])

    def refused(self) -> DataFrame:
        """``table_id, label, role`` of columns that may not stand in that role.

        A column is refused as what it is not over all batches; columns of tables that
        are still too small are refused as both.
        """
        rows = F.max("n_cells").over(Window.partitionBy("table_id"))
        sized = self.merged_profiles().withColumn("role", role_of(**self.rules)).withColumn("n_rows", rows)
        both = F.explode(F.array(F.lit("key"), F.lit("measure"))).alias("as")
        listed = sized.select("table_id", "label", both, "role", "n_rows")
        wrong = listed.where((F.col("n_rows") < self.min_rows) | ~F.col("role").eqNullSafe(F.col("as")))
        return wrong.select("table_id", "label", F.col("as").alias("role"))

    def sketches(self) -> DataFrame:
        """The sketch rows of every pair, as of one whole table each."""
        refused = self.refused()
        sums = self.merged_sums()
        for column, role in (("key_col", "key"), ("value_col", "measure")):
            names = refused.where(F.col("role") == role).select("table_id", F.col("label").alias(column))
            sums = sums.join(names, ["table_id", column], "left_anti")
        means = sums.select(*PAIR, "key", (F.col("total") / F.col("n")).alias("value"))
        return pair_sketch(means, self.opts)

    def terms(self) -> DataFrame:
        return sketch_terms(self.sketches(), self.opts).select("term", *PAIR)

    def replace(self, means: DataFrame) -> None:
        raise TypeError("means do not merge; append rows or cells to a new store")

    def compact(self) -> None:
        """Merge all batches into one; its tables may still grow."""
        self._write_parts(self._smallest(self.merged_sums()), self.merged_profiles(), uuid.uuid4().hex, alone=True)
