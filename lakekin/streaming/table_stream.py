"""Tables that arrive row by row and are indexed when they are complete.

A stateful stream keeps, per open table, the sums and counts of the keys with the
smallest hashes. An end mark, or a time without rows, closes the table: its sketch goes to
the store, its state is dropped, and a mark stays. Rows that come later are not lost:
they are handed on at once, as a further batch, and the store's sketches merge exactly.

State is bounded: a table's keys are dealt over ``salts`` groups by hash, so that a
table with a third of all rows is no single group, and each group holds at most one
sketch per pair. Before the exchange each task sums up its rows by key (in Arrow, without
Python objects) and keeps the sums of the keys that can still be in a sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakekin.functions.hashing import key_hash
from lakekin.operators.sketch_store import SketchStore
from lakekin.options import PAIR, SketchOptions
from lakekin.session import materialize

#: A stream of rows; a row with ``ended`` closes its table and carries nothing else.
ARRIVING_SCHEMA = "table_id string, key_col string, value_col string, key string, value double, ended boolean"
COMBINED_SCHEMA = (
    "table_id string, key_col string, value_col string, place string, key string, total double, n bigint, ended boolean"
)
COMBINED_COLUMNS = ["table_id", "key_col", "value_col", "place", "key", "total", "n", "ended"]
SUMS_SCHEMA = "table_id string, key_col string, value_col string, key string, total double, n bigint, late boolean"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SKETCH_COLUMNS = ["key_col", "value_col", "place", "key", "total", "n"]
STATE_SCHEMA = (
    "key_col array<string>, value_col array<string>, place array<string>, key array<string>, "
    "total array<double>, n array<bigint>, closed boolean"
)


#: Sums that a task holds between batches of rows.
HELD_ROWS = 1 << 16
SUMMED_BY = ["table_id", "key_col", "value_col", "place", "key"]
COMBINED_ARROW = pa.schema(
    [*[(c, pa.string()) for c in SUMMED_BY], ("total", pa.float64()), ("n", pa.int64()), ("ended", pa.bool_())]
)
NO_SUMS = pa.schema([f for f in COMBINED_ARROW if f.name != "ended"]).empty_table()


def summed(sums: pa.Table) -> list[pa.RecordBatch]:
    """Sums as rows of :data:`COMBINED_SCHEMA`."""
    return sums.append_column("ended", pa.array([False] * sums.num_rows, pa.bool_())).to_batches()


def smallest(rows: pd.DataFrame, table: list[str], size: int) -> pd.DataFrame:
    """Sums of equal keys, then per pair the ``size`` keys first in ``place`` and key order."""
    pair = [*table, "key_col", "value_col"]
    by_key = rows.groupby([*pair, "place", "key"], as_index=False).agg(total=("total", "sum"), n=("n", "sum"))
    return by_key.groupby(pair, sort=False).head(size)


class OpenTables:
    """Step of one (table, salt), whose state is a sketch per pair, or the mark that it was closed."""

    def __init__(self, size: int, idle_ms: int, remember_ms: int | None) -> None:
        self.size, self.idle_ms, self.remember_ms = size, idle_ms, remember_ms

    def __call__(self, key: tuple, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, known = False, None
        if state.exists:
            *arrays, closed = state.get
            known = pd.DataFrame(dict(zip(SKETCH_COLUMNS, map(list, arrays))))
        if state.hasTimedOut:
            if closed:
                state.remove()
            else:
                yield self._close(key[0], known, state)
            return
        arrived = pd.concat(list(blocks))
        ended = bool(arrived["ended"].any())
        new = smallest(arrived[~arrived["ended"]], [], self.size)
        if closed:
            self._remember(state)
            yield self._sums(key[0], new, late=True)
            return
        if known is not None:
            new = smallest(pd.concat([known, new]), [], self.size)
        if ended:
            yield self._close(key[0], new, state)
        else:
            state.update((*[new[c].tolist() for c in SKETCH_COLUMNS], False))
            state.setTimeoutDuration(self.idle_ms)

    def _remember(self, state: GroupState) -> None:
        state.update((*[[] for _ in SKETCH_COLUMNS], True))
        if self.remember_ms is not None:
            state.setTimeoutDuration(self.remember_ms)

    def _close(self, table_id: str, found: pd.DataFrame, state: GroupState) -> pd.DataFrame:
        self._remember(state)
        return self._sums(table_id, found, late=False)

    @staticmethod
    def _sums(table_id: str, found: pd.DataFrame, late: bool) -> pd.DataFrame:
        columns = ["table_id", "key_col", "value_col", "key", "total", "n", "late"]
        return found.assign(table_id=table_id, late=late)[columns]


def table_sums(
    rows: DataFrame,
    opts: SketchOptions = SketchOptions(),
    *,
    idle_seconds: float = 3600.0,
    remember_seconds: float | None = None,
    salts: int = 32,
) -> DataFrame:
    """Sums per (pair, key) of tables as they close, and of late rows as they come.

    ``rows`` is a stream of :data:`ARRIVING_SCHEMA`. A table without an end mark closes
    in the first batch that runs after ``idle_seconds`` without rows. The mark of a closed table is kept for ``remember_seconds``
    (for good, if not given); rows that come after it has gone open the table anew, and
    reach the store when it closes again.
    """
    ended = F.coalesce("ended", F.lit(False))
    placed = rows.select(
        *PAIR,
        "key",
        F.coalesce(key_hash(F.col("key"), opts).cast("string"), F.lit("")).alias("place"),
        F.when(~ended & F.col("key").isNotNull(), F.col("value").cast("double")).alias("total"),
        ended.alias("ended"),
    )
    size = opts.size

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = NO_SUMS
        for batch in batches:
            arrived = pa.Table.from_batches([batch])
            marks = arrived.filter(arrived["ended"])
            if marks.num_rows:
                marks = marks.append_column("n", pa.array([0] * marks.num_rows, pa.int64()))
                yield from marks.select(COMBINED_COLUMNS).cast(COMBINED_ARROW).to_batches()
            sums = arrived.filter(arrived["total"].is_valid()).group_by(SUMMED_BY)
            sums = sums.aggregate([("total", "sum"), ("total", "count")]).rename_columns(
                {"total_sum": "total", "total_count": "n"}
            )
            held = pa.concat_tables([held, sums.select(NO_SUMS.column_names).cast(NO_SUMS.schema)])
            if held.num_rows > HELD_ROWS:
                kept = smallest(held.to_pandas(), ["table_id"], size)
                held = pa.Table.from_pandas(kept[NO_SUMS.column_names], NO_SUMS.schema, preserve_index=False)
                if held.num_rows > HELD_ROWS // 2:
                    # Many pairs in one task: hand them on rather than hold them.
                    yield from summed(held)
                    held = NO_SUMS
        if held.num_rows:
            kept = smallest(held.to_pandas(), ["table_id"], size)
            yield from summed(pa.Table.from_pandas(kept[NO_SUMS.column_names], NO_SUMS.schema, preserve_index=False))

    everywhere = F.sequence(F.lit(0), F.lit(salts - 1))
    own = F.array(F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    combined = placed.mapInArrow(combine, COMBINED_SCHEMA)
    placed = combined.select("*", F.explode(F.when(F.col("ended"), everywhere).otherwise(own)).alias("salt"))
    remember = None if remember_seconds is None else int(remember_seconds * 1000)
    step = OpenTables(opts.size, int(idle_seconds * 1000), remember)
    return placed.groupBy("table_id", "salt").applyInPandasWithState(
        lambda key, blocks, state: step(key, blocks, state),
        SUMS_SCHEMA,
        STATE_SCHEMA,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def index_tables(
    rows: DataFrame, store: SketchStore, checkpoint: str, *, trigger: dict | None = None, **state
) -> StreamingQuery:
    """Start indexing the tables of ``rows`` (:func:`table_sums`) as they close.

    A batch that is repeated after a failure replaces its own output.
    """
    if store.opts.hash_order == "xxhash64":
        raise ValueError("state keeps hashes as text; xxhash64 has another order")

    def grow(batch: DataFrame, batch_id: int) -> None:
        # Written once: two actions would run the stateful step twice.
        store.append_sums(materialize(batch.drop("late"), "closed-tables"), f"stream-{batch_id}")

    trigger = trigger or {"availableNow": True}
    spark = rows.sparkSession
    before = spark.conf.get(NO_DATA_BATCHES)
    if "availableNow" in trigger:
        # Waiting for tables to fall silent, it would run empty batches without end.
        spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        # The query takes a copy of the settings when it starts.
        return (
            table_sums(rows, store.opts, **state)
            .writeStream.foreachBatch(grow)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
