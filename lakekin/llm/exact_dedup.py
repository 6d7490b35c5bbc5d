"""Exact deduplication with an extendible-hash index on shared files.

Each task first merges the equal texts it has read into entries (text, members).
Entries are written once. A directory over the leading bits of their keys doubles
where a bucket is overfull; a bucket is therefore a key range. Owner tasks read
whole buckets in key order, chain the different texts of one key and compare their
bytes; what they decide comes back by entry number, of which there is one each, so
no hot text ever meets its copies in one task.

Texts are equal when identical after white space is replaced. Of equal texts the row
with the smallest id stays (null ids come last). Defined results: a null text counts
as empty; of rows with the same id and text one stays; other columns are carried
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekin.session import materialize

#: Text a bucket holds before it is split.
BUCKET_BYTES = 16 << 20
#: Text a task holds while merging, before it writes its entries.
MERGE_BYTES = 24 << 20
#: Leading key bits the directory may use.
MAX_DEPTH = 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _merged(batches: list[pa.RecordBatch], groups: dict[str, int], at: list[np.ndarray], base: int) -> pa.RecordBatch:
    """Entries of the rows held: members sorted by id, the first one's text kept."""
    table = pa.Table.from_batches(batches).combine_chunks()
    group = np.concatenate(at)
    ids = table.column("row").combine_chunks().field("doc_id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((values, null, group))
    counts = np.bincount(group, minlength=len(groups))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    firsts = pa.array(order[offsets[:-1]])
    rows = table.column("row").combine_chunks().take(pa.array(order))
    one = table.take(firsts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(base + np.arange(len(groups), dtype=np.int64)),
            one.column("key").combine_chunks(),
            one.column("sha").combine_chunks(),
            one.column("raw").combine_chunks(),
            pa.array(counts.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows),
        ],
        names=["entry", "key", "sha", "text", "n", "members"],
    )


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """``entry, key, sha, text, n, members``: each task's distinct texts, written once.

    ``members`` has the rows of the entry as structs of ``doc_id`` and, under
    ``row``, all columns but the text. ``key_bits`` below 64 makes keys collide and
    is for tests.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(id_col).alias("doc_id"), F.struct(*[F.col(c) for c in others]).alias("row"))
    norm = normalised(F.col(text_col))
    prepared = docs.select(
        row.alias("row"),
        F.col(text_col).alias("raw"),
        norm.alias("norm"),
        F.shiftleft(F.xxhash64(norm), 64 - key_bits).alias("key") if key_bits < 64 else F.xxhash64(norm).alias("key"),
        F.sha2(norm, 256).alias("sha"),
    )
    member = prepared.schema["row"].dataType
    schema = T.StructType(
        [
            T.StructField("entry", T.LongType(), False),
            T.StructField("key", T.LongType(), False),
            T.StructField("sha", T.StringType(), False),
            T.StructField("text", T.StringType()),
            T.StructField("n", T.LongType(), False),
            T.StructField("members", T.ArrayType(member), False),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        groups: dict[str, int] = {}
        held: list[pa.RecordBatch] = []
        at: list[np.ndarray] = []
        size = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column("norm").to_pylist()
                before = len(groups)
                at.append(np.array([groups.setdefault(t, len(groups)) for t in texts], np.int64))
                size += sum(map(len, texts)) if len(groups) > before else 64 * len(texts)
                held.append(batch.select(["row", "raw", "key", "sha"]))
                if size > MERGE_BYTES:
                    yield _merged(held, groups, at, base)
                    base += len(groups)
                    groups, held, at, size = {}, [], [], 0
        if held:
            yield _merged(held, groups, at, base)

    return materialize(prepared.mapInArrow(work, schema), "entries")


def directory(stored: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """``slot, depth, bucket`` for each slot of the directory in use.

    A slot is the leading bits of a key; its bucket is the shortest prefix whose
    entries fit, which is where splitting and doubling from one bucket would end.
    """
    whole = stored.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("b")).first()["b"] or 0
    bits = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1, whole / capacity))) + 4))
    slots = stored.groupBy(slot(bits).alias("slot")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes")
    )
    depths = slots.select("slot", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(slot, {bits} - depth)")
    buckets = depths.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    buckets = buckets.filter((F.col("bytes") <= capacity) | (F.col("depth") == bits))
    fitting = depths.select("slot", "depth", prefix.alias("prefix")).join(buckets, ["depth", "prefix"])
    found = fitting.groupBy("slot").agg(F.min("depth").alias("depth"))
    number = F.expr(f"shiftleft(1L, depth) + shiftright(slot, {bits} - depth)")
    return materialize(found.select("slot", "depth", number.alias("bucket"), F.lit(bits).alias("bits")), "directory")


def slot(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of (key, first id): chain different texts, number the equal ones.

    Holds the distinct texts of one key and, for them, entry numbers only.
    """
    names = ["entry", "keep_id", "group_size", "keeper"]
    key, chains = None, []

    def flush() -> pa.RecordBatch:
        rows = [(e, keep, total, i == 0) for _, keep, total, found in chains for i, e in enumerate(found)]
        entry, keep, total, keeper = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(entry, pa.int64()), pa.array(keep, pa.int64()), pa.array(total, pa.int64()), pa.array(keeper)],
            names=names,
        )

    for batch in batches:
        done = []
        for start in range(0, batch.num_rows, 256):
            columns = [batch.slice(start, 256).column(c).to_pylist() for c in ("entry", "key", "norm", "n", "first_id")]
            for entry, own, text, n, first in zip(*columns):
                if own != key:
                    if chains:
                        done.append(flush())
                    key, chains = own, []
                for chain in chains:
                    if chain[0] == text:
                        chain[2] += n
                        chain[3].append(entry)
                        break
                else:
                    chains.append([text, first, n, [entry]])
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if chains:
        yield flush()


def decide(stored: DataFrame, slots: DataFrame) -> DataFrame:
    """``entry, keep_id, group_size, keeper`` from the owner task of each bucket."""
    row = slots.select(F.max("bits").alias("bits")).first()
    bits = row["bits"] or 1
    first = F.element_at("members", 1)
    index = stored.select(
        "entry", "key", "n", F.col("text"), first["doc_id"].alias("first_id"), slot(bits).alias("slot")
    )
    owned = index.join(slots.select("slot", "bucket"), "slot").drop("slot")
    owned = owned.repartition(F.col("bucket")).sortWithinPartitions("bucket", "key", F.col("first_id").asc_nulls_last(), "entry")
    owned = owned.select("entry", "key", normalised(F.col("text")).alias("norm"), "n", "first_id")
    return owned.mapInArrow(_chained, "entry long, keep_id long, group_size long, keeper boolean")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    stored = entries(docs.select(id_col, text_col), id_col, text_col, key_bits)
    decided = decide(stored, directory(stored, capacity))
    joined = stored.select("entry", "sha", F.col("members.doc_id").alias("ids")).join(decided, "entry")
    rows = joined.select("*", F.posexplode("ids").alias("at", "doc_id"))
    kept = F.col("keeper") & (F.col("at") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns unchanged."""
    stored = entries(docs, id_col, text_col)
    keepers = decide(stored, directory(stored)).filter("keeper").select("entry")
    rows = stored.join(keepers, "entry", "left_semi")
    first = F.element_at("members", 1)["row"]
    columns = [F.col("text").alias(c) if c == text_col else first[c].alias(c) for c in docs.columns]
    return rows.select(*columns)
