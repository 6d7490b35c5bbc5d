"""A term index kept as Parquet: append, replace, open for search.

Every write of a batch is an attempt with a folder of its own. Its terms come
first, the list of its tables second; one row in ``commits`` then makes the
attempt the batch's content, or the only content. Commits are only ever added
and the latest one counts, so readers see the old content or the new, whatever
point a writer reached, and repeating an append changes nothing. ``compact``
merges committed batches into one; ``vacuum`` removes what no commit uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekin.operators.pairs import LakeTable, cell_pair_means, sketch_candidates, sketch_means
from lakekin.operators.search import prune_index
from lakekin.operators.sketch import term_index
from lakekin.options import PAIR, SketchOptions
from lakekin.session import empty_frame, materialize

TERM_SCHEMA = "term string, table_id string, key_col string, value_col string"


def append_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Index with the terms of tables it does not hold yet (no files involved)."""
    known = index.select("table_id").distinct()
    return index.unionByName(terms.join(known, "table_id", "left_anti").select("term", *PAIR))


class TermStore:
    """One stored index."""

    #: Folders of which every attempt has one of its own.
    PARTS: tuple[str, ...] = ("terms", "tables")

    def __init__(self, spark: SparkSession, path: str, opts: SketchOptions = SketchOptions()) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.opts = opts
        stored = self._read("options", "fingerprint string").first()
        if stored is None:
            row = spark.createDataFrame([(opts.fingerprint(),)], "fingerprint string")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/options")
        elif stored["fingerprint"] != opts.fingerprint():
            raise ValueError(
                f"index was built with {stored['fingerprint']}, not {opts.fingerprint()}"
            )

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_frame(self.spark, schema)

    def attempts(self) -> dict[str, str]:
        """The attempt in force of every batch. Commits are one row per write."""
        commits = self._read("commits", "number bigint, batch string, attempt string, alone boolean")
        found: dict[str, str] = {}
        for row in sorted(commits.collect(), key=lambda r: (r["number"], r["attempt"])):
            if row["alone"]:
                found = {}
            found[row["batch"]] = row["attempt"]
        return found

    def tables(self) -> DataFrame:
        """Committed ``(table_id, batch)``."""
        found = self.attempts()
        listed = self._read("tables", "table_id string, batch string, attempt string")
        return listed.where(F.col("attempt").isin(list(found.values()))).select("table_id", "batch")

    def terms(self) -> DataFrame:
        """Terms of all committed batches; other folders are not even listed."""
        found = list(self.attempts().values())
        if not found:
            return empty_frame(self.spark, TERM_SCHEMA)
        paths = [f"{self.path}/terms/attempt={a}" for a in found]
        return self.spark.read.schema(TERM_SCHEMA).parquet(*paths)

    def append(self, means: DataFrame, batch: str) -> None:
        """Index the tables of ``means`` that are not in the store yet."""
        known = self.tables().where(F.col("batch") != batch).select("table_id")
        fresh = means.join(known, "table_id", "left_anti")
        self._write(term_index(fresh, self.opts), batch)

    def append_tables(self, lake: Sequence[LakeTable], batch: str, *, two_pass: bool = False) -> None:
        """Index wide tables; those already in the store are not even read.

        ``two_pass`` reads the tables twice to avoid shuffling keys that
        cannot be sampled; it pays when tables hold many distinct keys.
        """
        ids = [t.table_id for t in lake]
        known = self.tables().where(F.col("table_id").isin(ids) & (F.col("batch") != batch))
        # No more rows than tables in the list.
        skip = {row["table_id"] for row in known.select("table_id").collect()}
        fresh = [t for t in lake if t.table_id not in skip]
        if not fresh:
            return
        if two_pass:
            if self.opts.hash_order != "be":
                raise ValueError("two passes need the default hash order")
            means = sketch_candidates(fresh, self.opts.size)
        else:
            means = sketch_means(fresh, self.opts)
        self._write(term_index(means, self.opts), batch)

    def append_cells(self, cells: DataFrame, batch: str, *, stage: bool = False, **rules) -> None:
        """Index the tables of a tall lake; cells of known tables are dropped first.

        The build reads the cells three times. ``stage`` writes them to the
        shared folder first, which is right for cells that are being decoded
        from files and wrong for cells that are stored already.
        """
        known = self.tables().where(F.col("batch") != batch).select("table_id").distinct()
        fresh = cells.join(known, "table_id", "left_anti")
        if stage:
            fresh = materialize(fresh, "cells")
        self._write(term_index(cell_pair_means(fresh, **rules), self.opts), batch)

    def _write(self, terms: DataFrame, batch: str, *, alone: bool = False) -> None:
        """Write one attempt and commit it; ``alone`` makes it the only content."""
        attempt = uuid.uuid4().hex
        target = f"{self.path}/terms/attempt={attempt}"
        (
            # The pair columns split a frequent term over several files.
            terms.repartitionByRange("term", *PAIR)
            .sortWithinPartitions("term")
            .write.option("parquet.bloom.filter.enabled#term", "true")
            .parquet(target)
        )
        written = self.spark.read.schema(TERM_SCHEMA).parquet(target)
        listed = written.select("table_id").distinct().withColumn("batch", F.lit(batch))
        listed.write.parquet(f"{self.path}/tables/attempt={attempt}")
        self._commit(attempt, batch, alone)

    def _commit(self, attempt: str, batch: str, alone: bool) -> None:
        """Put an attempt that is written whole in force."""
        number = self._read("commits", "number bigint").agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
        row = self.spark.range(1).select(
            (number + 1).alias("number"), F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.lit(alone).alias("alone")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def replace(self, means: DataFrame) -> None:
        """Make ``means`` the only content."""
        self._write(term_index(means, self.opts), uuid.uuid4().hex, alone=True)

    def compact(self) -> None:
        """Merge all committed batches into one, sorted by term.

        Many small appends leave many small files, whose footers every search
        opens. Batch names are forgotten; their tables stay known.
        """
        self._write(self.terms(), uuid.uuid4().hex, alone=True)

    def vacuum(self) -> list[str]:
        """Remove the folders of attempts that no commit uses; none may be running."""
        used = set(self.attempts().values())
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        removed = []
        for part in self.PARTS:
            root = fs_path(f"{self.path}/{part}")
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(root) if fs.exists(root) else []:
                name = status.getPath().getName()
                if name.startswith("attempt=") and name.removeprefix("attempt=") not in used:
                    fs.delete(status.getPath(), True)
                    removed.append(f"{part}/{name}")
        return removed

    def for_query(self, means: DataFrame, *, query_size: int | None = None) -> DataFrame:
        """The part of the index that holds the query's terms.

        ``query_size`` has to be the one the search will use: the labels
        depend on the mean of the query's sketch.
        """
        opts = SketchOptions(**{**self.opts.__dict__, "size": query_size or self.opts.size})
        return prune_index(self.terms(), means, opts)
