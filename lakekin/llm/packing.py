"""Packing token sequences into fixed-length rows, best fit decreasing.

Documents are split losslessly into pieces no longer than a row. Pieces are dealt to
shards by hash, each shard small enough for one task; in a shard, pieces go in order
of falling length into the row with the least room that still takes them, found by a
segment tree over room sizes. A row is written as its ids, the cumulative lengths of
its segments, and the positions at which position ids start anew.

Defined results: a null or empty text gives no piece; with ``end_id`` every document
ends with it; rows repeated in the input are packed as often; a document is in its
pieces, in order of their offsets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.llm import text as tx

#: Ids in a row.
ROW = 2048
#: Ids of a shard, about. A piece is no longer than a row, so no shard gets much more.
SHARD_IDS = 8 << 20
#: Byte vocabulary: a byte's id is its value. The ids of the end of a document and of
#: filling are bytes that UTF-8 never uses.
END_ID, PAD_ID = 0xFF, 0xFE


class RoomTree:
    """Segment tree over room sizes: the least size with an open row, not below a need."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(room, row)``, or None when no row has the room."""
        at = need + self.size
        if not self.any[at]:
            # Up to the first ancestor with something to its right, then down leftmost.
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at and not self.rows[room]:
            if at < self.size and (self.any[2 * at] or self.any[2 * at + 1]):
                break
            self.any[at] = 0
            at >>= 1
        return room, row


def best_fit(lengths: np.ndarray, row: int = ROW) -> np.ndarray:
    """The row of each piece, lengths given in falling order."""
    tree = RoomTree(row)
    placed = np.zeros(len(lengths), np.int64)
    opened = 0
    for i, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            room, at = row, opened
            opened += 1
        else:
            room, at = found
        placed[i] = at
        tree.add(room - length, at)
    return placed


def byte_pieces(docs: DataFrame, shards: int, row: int = ROW) -> DataFrame:
    """``shard, doc_id, start, n, ids`` of ``doc_id, text``; ids as one byte each.

    A document's ids are its UTF-8 bytes and :data:`END_ID`.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                data, offsets = tx.utf8(part.column("text"))
                sizes = np.diff(offsets)
                lengths = np.where(sizes > 0, sizes + 1, 0)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                ids = np.full(bounds[-1], END_ID, np.uint8)
                ends = np.zeros(bounds[-1], bool)
                ends[bounds[1:][lengths > 0] - 1] = True
                ids[~ends] = data
                count = -(-lengths // row)
                doc = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * row
                n = np.minimum(row, lengths[doc] - start)
                first = bounds[doc] + start
                raw = ids.tobytes()
                pieces = pa.array([raw[a:b] for a, b in zip(first, first + n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(n), pieces],
                    names=["doc_id", "start", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.mapInArrow(work, f"doc_id {kind}, start long, n long, ids binary")
    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(shards)).cast("int"))


def pack(pieces: DataFrame, row: int = ROW, pad_id: int = PAD_ID, width: int = 1) -> DataFrame:
    """One line per packed row, from ``shard, doc_id, start, n, ids``.

    ``width`` is the bytes of an id (little endian; 2 for most vocabularies).
    ``shard, row, n_ids, ids`` (filled up), ``cumulative`` (bounds of
    the segments), ``resets`` (where position ids start anew), and per segment
    ``doc_ids`` and ``starts`` (its first id's place in the document).
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        order = [("n", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]
        table = table.sort_by(order)
        lengths = table.column("n").to_numpy()
        placed = best_fit(lengths, row)
        rows = int(placed.max()) + 1
        by_row = np.argsort(placed, kind="stable")
        counts = np.bincount(placed, minlength=rows)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sorted_lengths = lengths[by_row]
        used = np.bincount(placed, weights=lengths, minlength=rows).astype(np.int64)
        ids = table.column("ids").combine_chunks()
        pieces = [ids[i].as_buffer() for i in by_row.tolist()]
        fill = np.full(row, pad_id, f"<u{width}").tobytes()
        matrix, cumulative, resets = [], [], []
        for r in range(rows):
            a, b = bounds[r], bounds[r + 1]
            matrix.append(b"".join(pieces[a:b]) + fill[: width * (row - used[r])])
            at = np.concatenate([[0], np.cumsum(sorted_lengths[a:b])])
            cumulative.append(at)
            resets.append(at[:-1])
        listed = lambda name: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), table.column(name).combine_chunks().take(pa.array(by_row)))
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * rows, pa.int32()),
                "row": pa.array(range(rows), pa.int64()),
                "n_ids": pa.array(used),
                "ids": pa.array(matrix, pa.binary()),
                "cumulative": pa.array(cumulative, pa.list_(pa.int32())),
                "resets": pa.array(resets, pa.list_(pa.int32())),
                "doc_ids": listed("doc_id"),
                "starts": listed("start"),
            }
        )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"shard int, row long, n_ids long, ids binary, cumulative array<int>, resets array<int>, doc_ids array<{kind}>, starts array<long>"
    return pieces.groupBy("shard").applyInArrow(work, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Documents as packed rows of byte ids."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return pack(byte_pieces(narrow, max(1, -(-total // shard_ids)), row), row)
