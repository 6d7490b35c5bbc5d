"""Sharding by longest processing time: rows of one group stay together, bytes are level.

Groups, sorted by size, go to the least loaded shard through a heap. A heap takes one
group after another, so it must not see all groups of a large table: above
:data:`PER_HEAP` groups they are dealt by hash into buckets of about that many, a heap
in each bucket makes :data:`PILES` piles of them, and the piles are the groups of the
next round. Each round divides their number by about 25; the last heap deals what is
left to the shards. A group that is larger than its bucket's share is a pile of its
own, so no huge group drags others along.

Copies are counted before the shuffle of groups, and texts go no further than the scan.

Defined results: a null text and an empty one are equal and have size 1; groups of
equal size go by their smallest id, nulls first, then by the text's digest; a table
with fewer groups than shards leaves shards empty; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekin.llm.order import numbered
from lakekin.session import materialize

SHARDS = 8
#: Groups that one heap deals out (on average; buckets are random).
PER_HEAP = 50_000
#: Piles that a bucket's heap makes.
PILES = 2048


def least_loaded(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, in the given order; of equal loads the lowest shard."""
    heap = [(0, k) for k in range(shards)]
    taken = []
    for size in sizes:
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        taken.append(k)
    return taken


def deal(shards: int):
    """A function for the groups of one bucket: their pile, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = [("size", "descending"), ("first", "ascending"), ("item", "ascending")]
        table = table.sort_by(order)
        piles = least_loaded(table.column("size").to_pylist(), shards)
        out = table.select(["bucket", "item", "size"]).append_column("pile", pa.array(np.array(piles, np.int32)))
        yield from out.to_batches(max_chunksize=10_000)

    return run


def dealt(items: DataFrame, buckets: int, shards: int) -> DataFrame:
    """``bucket, item, size, pile`` for ``item, size, first``."""
    bucket = F.pmod(F.xxhash64("item"), F.lit(buckets))
    keyed = items.select("item", "size", "first", bucket.alias("bucket"))
    schema = "bucket long, item string, size long, pile int"
    return keyed.groupBy("bucket").applyInArrow(deal(shards), schema)


def assign(groups: DataFrame, shards: int = SHARDS, per_heap: int = PER_HEAP, piles: int = PILES) -> DataFrame:
    """``item, shard`` for every ``item, size, first`` (``first`` orders equal sizes, no nulls)."""
    items, path = groups, []
    n = items.count()
    while n > per_heap:
        buckets = -(-n // per_heap)
        found = materialize(dealt(items, buckets, piles), "lpt-piles")
        name = F.concat_ws("/", "bucket", "pile")
        path.append(found.select("item", name.alias("pile")))
        items = found.groupBy(name.alias("item")).agg(F.sum("size").alias("size"))
        items = materialize(items.withColumn("first", F.col("item")), "lpt-items")
        n = items.count()
    last = dealt(items, 1, shards).select("item", F.col("pile").alias("shard"))
    for step in reversed(path):
        last = step.join(last.withColumnRenamed("item", "pile"), "pile").select("item", "shard")
    return last


def first_key(id_col: Column) -> Column:
    """Text that sorts as the ids do: nulls, then numbers by value (or texts)."""
    number = id_col.try_cast("decimal(38,0)")
    wide = F.lpad((number + F.lit(10**18).cast("decimal(38,0)") * 100).cast("string"), 39, "0")
    return F.coalesce(F.when(number.isNotNull(), F.concat(F.lit("n"), wide)), F.concat(F.lit("t"), id_col.cast("string")), F.lit(""))


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, per_heap: int = PER_HEAP, piles: int = PILES) -> DataFrame:
    """``doc_id, size, text_crc32, text_sha256, shard, slot`` for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    rows = materialize(rows, "lpt-rows")
    groups = rows.groupBy(F.col("text_sha256").alias("item")).agg(F.sum("size").alias("size"), F.min(first_key(F.col("doc_id"))).alias("first"))
    found = assign(materialize(groups, "lpt-groups"), shards, per_heap, piles)
    placed = materialize(rows.join(found.withColumnRenamed("item", "text_sha256"), "text_sha256"), "lpt-placed")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_sha256").asc()]
    return numbered(placed, "shard", order, "lpt-slots").withColumnRenamed("pos", "slot").drop("n")
