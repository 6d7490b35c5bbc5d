"""Bottom-k key sketches and their sign-labelled terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekin.functions.hashing import key_hash, sign_label, term
from lakekin.options import PAIR, SketchOptions

# Above this size Spark no longer limits groups before the shuffle by itself.
GROUP_LIMIT = 1000
PRE_LIMIT_SALTS = 64


def pair_sketch(means: DataFrame, opts: SketchOptions = SketchOptions()) -> DataFrame:
    """Keep per pair the ``opts.size`` keys with the smallest hash.

    Each task keeps at most ``size`` keys of a pair before the shuffle, so a
    pair with most of the lake's keys is no hot spot.
    """
    hashed = means.withColumn("key_hash", key_hash(F.col("key"), opts))
    order = [F.col("key_hash"), F.col("key")]
    if opts.size > GROUP_LIMIT:
        salted = Window.partitionBy(*PAIR, "salt").orderBy(*order)
        hashed = (
            hashed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(PRE_LIMIT_SALTS)))
            .withColumn("sketch_rank", F.row_number().over(salted))
            .where(F.col("sketch_rank") <= opts.size)
            .drop("salt", "sketch_rank")
        )
    by_pair = Window.partitionBy(*PAIR).orderBy(*order)
    return (
        hashed.withColumn("sketch_rank", F.row_number().over(by_pair))
        .where(F.col("sketch_rank") <= opts.size)
        .select(*PAIR, "key", "value", "key_hash", "sketch_rank")
    )


def with_mean(sketch: DataFrame, group: Sequence[str] = PAIR) -> DataFrame:
    """Attach the sketch mean; reuses the partitioning of the sketch."""
    return sketch.withColumn("mean", F.avg("value").over(Window.partitionBy(*group)))


def sketch_terms(sketch: DataFrame, opts: SketchOptions = SketchOptions()) -> DataFrame:
    """Inverted index rows ``(term, pair)`` of a sketch."""
    sign = sign_label(F.col("value"), F.col("mean"), opts)
    return with_mean(sketch).select(term(F.col("key"), sign, opts).alias("term"), *PAIR)


def term_index(means: DataFrame, opts: SketchOptions = SketchOptions()) -> DataFrame:
    """Index rows of pair means: sketch, label, hash."""
    return sketch_terms(pair_sketch(means, opts), opts)


def query_terms(means: DataFrame, opts: SketchOptions = SketchOptions()) -> DataFrame:
    """Distinct ``(term, side)`` of a query, for the measure and its negation.

    Keys are the same on both sides, so one sketch serves both. At most
    ``2 * size`` rows per query pair.
    """
    sketch = with_mean(pair_sketch(means, opts))
    plus = sign_label(F.col("value"), F.col("mean"), opts)
    minus = sign_label(F.col("value"), F.col("mean"), opts, negate=True)
    sides = F.explode(
        F.array(
            F.struct(F.lit("+").alias("side"), term(F.col("key"), plus, opts).alias("term")),
            F.struct(F.lit("-").alias("side"), term(F.col("key"), minus, opts).alias("term")),
        )
    )
    return sketch.select(sides.alias("s")).select("s.term", "s.side").distinct()


def inverted_lists(terms: DataFrame) -> DataFrame:
    """The map form of the index: term -> set of pairs.

    A list is as long as its term is common; the searches use the plain rows.
    """
    return terms.groupBy("term").agg(F.collect_set(F.struct(*PAIR)).alias("pairs"))


def index_stats(terms: DataFrame) -> DataFrame:
    """Distinct terms and mean leading hash digits per pair (hash uniformity)."""
    prefix = F.conv(F.substring("term", 1, 7), 16, 10).cast("long")
    return terms.groupBy(*PAIR).agg(
        F.count_distinct("term").alias("n_terms"), F.avg(prefix).alias("mean_prefix")
    )
