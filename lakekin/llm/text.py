"""Vectorised work on the texts of an Arrow batch: words, lines, hashes.

All positions are byte positions in the UTF-8 buffer of a block of texts. Equality
of words, lines and runs is equality of 64-bit hashes computed here. A hash chains
every eight bytes through a bijection of the state, so no pattern of the bytes alone
makes two spans meet.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a task (or one text, if that is longer).
BLOCK_BYTES = 2 << 20

#: Spans longer than this are hashed one by one.
LONG = 256
#: Starts every hash.
SEED = np.uint64(0x9E6F4A7C15D3B1E5)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts come to ``limit`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one buffer, and where each text begins (null: empty)."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap``, none across two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~gap[data]
    left, right = cut[:-1].copy(), cut[1:].copy()
    left[0] = right[-1] = True
    left[1:] |= ~inside[:-1]
    right[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span: of its length, then of eight bytes after eight."""
    size = ends - starts
    hashes = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + SEED)
    long = np.flatnonzero(size > LONG)
    if len(long):
        buffer = memoryview(np.ascontiguousarray(data))
        hashes[long] = [xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(starts[long], ends[long])]
    live = np.flatnonzero((size > 0) & (size <= LONG))
    if not len(live):
        return hashes
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at, left = starts[live], size[live]
    while len(live):
        chunk = words[at].view("<u8").ravel() & FIRST[np.minimum(left, 8)]
        hashes[live] = mix(hashes[live] ^ chunk)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashes


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives unused memory back when its task ends, as workers live on."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise mark over each text."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
