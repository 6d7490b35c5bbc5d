"""Whitening of embeddings by a covariance over distinct vectors with multiplicities.

Vectors become integers, ``x = floor(64 * c) + 1000000``, and equal x vectors are one
row with their count. A fit takes each distinct vector with weight one or with its
count. Sums and counts are exact; deviations ``n * x - S`` are exact integers, so
centring loses nothing before the weighted matrix product, which tasks compute
batch by batch and Spark adds up entry by entry. The eigenvectors of one small matrix
are found on the driver. Each distinct vector is projected once and joined back to
the rows that carry it.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry
are dropped, as are rows of another length than the most frequent one (of equally
frequent ones the longest); entries are held within ±2^53 before they are rounded;
a deviation beyond 64 bits is null; components whose eigenvalue is not above
:data:`LEAST` of the trace do not exist (so a single distinct vector gives no rows);
repeated rows and null ids give rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.session import materialize

SCALE = 64
SHIFT = 1_000_000
#: Components returned at most.
COMPONENTS = 16
#: Vectors are at most this long: the driver holds a few square matrices of that side.
MAX_DIMS = 4096
#: Share of the trace that an eigenvalue must exceed.
LEAST = 1e-12
#: Bytes of doubles that one step of a task works on.
STEP_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a list of finite entries, and those lists end to end.

    Returns a mask over all rows and the lengths of the lists that pass with their values.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).cast(pa.float64())
    bad = ~np.isfinite(values.to_numpy(zero_copy_only=False))  # nulls are NaN here
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[owner[bad]] = False
    return good, values.to_numpy(zero_copy_only=False)[good[owner]]


def whole(values: np.ndarray) -> np.ndarray:
    """The integers of entries."""
    limit = float(1 << 53)
    return np.floor(np.clip(values * SCALE, -limit, limit)).astype(np.int64) + SHIFT


def integer_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """``id, dims, x`` per usable row of ``id, <vector>``; ``x`` is the integers' bytes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column("vector")
            good, values = matrix(column)
            lengths = pc.list_value_length(column).filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)
            x = whole(values)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            ids = batch.column("id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths.astype(np.int32)), packed.cast(pa.binary())], ["id", "dims", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col(vector_col).alias("vector")).mapInArrow(run, f"id {kind}, dims int, x binary")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``key, x, copies``: each distinct x once. Copies are counted before the shuffle."""
    keyed = vectors.groupBy(F.sha2("x", 256).alias("key"), "x")
    return keyed.agg(F.count("*").alias("copies"))


def unpack(column: pa.Array, kind: type) -> np.ndarray:
    """A matrix from a column of equally long packed rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def steps(batches: Batches, dims: int) -> Batches:
    """Slices whose vectors, as doubles, take about :data:`STEP_BYTES`."""
    size = max(1, STEP_BYTES // (8 * dims))
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def add_up(fit: DataFrame, name: str, entries: int, part: Callable[[pa.RecordBatch], np.ndarray], dims: int, exact: bool) -> np.ndarray:
    """Sum of ``part`` over all batches: one array per task, added entry by entry in Spark."""
    kind = np.int64 if exact else np.float64

    def run(batches: Batches) -> Batches:
        total = np.zeros(entries, kind)
        for step in steps(batches, dims):
            total += part(step)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(entries, dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = fit.select(name, "weight").mapInArrow(run, f"i int, v {'long' if exact else 'double'}")
    found = sums.groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(entries, kind)
    for row in found:
        out[row["i"]] = row["v"]
    return out


def weights_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("weight").to_numpy(zero_copy_only=False)


def covariance(fit: DataFrame, name: str, dims: int, n: int, centred: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """Weighted product of the centred rows with themselves, over ``n``."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        c = centred(unpack(batch.column(name), kind))
        return ((c * weights_of(batch)[:, None]).T @ c).ravel()

    return add_up(fit, name, dims * dims, part, dims, exact=False).reshape(dims, dims) / n


def squares(dev: np.ndarray) -> pa.Array:
    """Exact row sums of squares as 64-bit integers; null where they do not fit."""
    most = float(np.abs(dev.astype(np.float64)).max(initial=0))
    if most * most * dev.shape[1] < float(1 << 62):
        return pa.array((dev * dev).sum(axis=1))
    sums = [sum(int(v) ** 2 for v in row) for row in dev]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def project(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> DataFrame:
    """``key, weight, deviation, white`` per distinct vector; ``white`` is packed doubles."""
    dims = len(sums)

    def run(batches: Batches) -> Batches:
        for step in steps(batches, dims):
            dev = n * unpack(step.column("x"), np.int64) - sums
            white = np.ascontiguousarray((dev / n) @ basis)
            packed = pa.array([row.tobytes() for row in white], pa.binary())
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("weight"), squares(dev), packed], ["key", "weight", "deviation", "white"])

    return fit.select("key", "weight", "x").mapInArrow(run, "key string, weight long, deviation long, white binary")


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, and unit eigenvectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    trace = float(np.trace(covariance))
    order = order[values[order] > LEAST * trace] if trace > 0 else order[:0]
    values, vectors = values[order], vectors[:, order]
    if len(order):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    ``weights`` is ``one`` (each distinct vector once) or ``counts`` (as often as it occurs).
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    vectors = integer_vectors(named, "vector")
    distinct = materialize(distinct_vectors(vectors), "whitening-distinct")
    sized = distinct.groupBy((F.octet_length("x") / 8).cast("int").alias("dims")).agg(F.sum("copies").alias("rows"))
    longest = sized.agg(F.max_by("dims", F.struct("rows", "dims"))).first()[0]
    kind = named.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema)
    if longest is None:
        return nothing
    dims = int(longest)
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are whitened")
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    fit = distinct.where(F.octet_length("x") == 8 * dims).withColumn("weight", weight)
    n = int(fit.agg(F.sum("weight")).first()[0])

    def part(batch: pa.RecordBatch) -> np.ndarray:
        return (unpack(batch.column("x"), np.int64) * weights_of(batch)[:, None]).sum(axis=0)

    sums = add_up(fit, "x", dims, part, dims, exact=True)
    spread = covariance(fit, "x", dims, n, lambda x: (n * x - sums) / n, np.int64)
    values, basis = components(spread, most)
    k = len(values)
    if not k:
        return nothing
    white = materialize(project(fit, n, sums, basis / np.sqrt(values)), "whitening-white")

    def white_part(batch: pa.RecordBatch) -> np.ndarray:
        return (unpack(batch.column("white"), np.float64) * weights_of(batch)[:, None]).sum(axis=0)

    centre = add_up(white, "white", k, white_part, k, exact=False) / n
    error = float(np.abs(covariance(white, "white", k, n, lambda w: w - centre, np.float64) - np.eye(k)).max())
    shares = [float(v) for v in values / np.trace(spread)]

    def spell(batches: Batches) -> Batches:
        for step in steps(batches, k):
            flat = unpack(step.column("white"), np.float64)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * k, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("deviation"), lists], ["key", "deviation", "whitened"])

    spelled = white.mapInArrow(spell, "key string, deviation long, whitened array<double>")
    carriers = vectors.where(F.col("dims") == dims).select("id", F.sha2("x", 256).alias("key"))
    joined = carriers.join(spelled, "key").select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return joined.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.lit(shares), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
