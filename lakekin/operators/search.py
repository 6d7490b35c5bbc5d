"""Searches over a term index: probe, count, rank.

The query side is two terms per sketch key and query pair, however many pairs
the query has; it is broadcast, or pushed into the scan, only when its measured
size allows. Both signs are counted in one pass over the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekin.operators.sketch import query_terms
from lakekin.options import COUNTER_QUERY_SIZE, COUNTER_TOP, PAIR, SketchOptions

# Query terms are pushed into the scan as literals up to this many.
MAX_LITERALS = 16_384


def match_counts(index: DataFrame, means: DataFrame, opts: SketchOptions) -> DataFrame:
    """Index rows per (pair, side) whose term is one of the query's terms.

    The plan states no join strategy: adaptive execution broadcasts the terms
    when their measured size is small.
    """
    hits = index.join(query_terms(means, opts), "term")
    return hits.groupBy(*PAIR, "side").agg(F.count("*").alias("matches"))


def prune_index(index: DataFrame, means: DataFrame, opts: SketchOptions) -> DataFrame:
    """Restrict a stored index to the query's terms at the scan.

    A few thousand terms become an IN filter that the Parquet reader checks
    against page ranges and Bloom filters, so most of the index is not read. A
    query with more terms is joined instead, with the same rows.
    """
    terms = query_terms(means, opts).select("term").distinct()
    # One more than allowed, to tell a full list from one that was cut.
    literals = [row["term"] for row in terms.limit(MAX_LITERALS + 1).collect()]
    if len(literals) > MAX_LITERALS:
        return index.join(terms, "term", "left_semi")
    return index.where(F.col("term").isin(literals)) if literals else index.where(F.lit(False))


def pair_id(separator: str = "__", joiner: str = "_") -> Column:
    """Display id of a pair; never parsed back."""
    return F.concat("table_id", F.lit(separator), "key_col", F.lit(joiner), "value_col")


def search_signed(
    index: DataFrame,
    means: DataFrame,
    k: int,
    opts: SketchOptions = SketchOptions(),
) -> DataFrame:
    """Top k (pair, sign) by match count, positive and negative hits in one list."""
    counts = match_counts(index, means, opts)
    suffix = F.when(F.col("side") == "+", "-QPlus").otherwise("-QMinus")
    return (
        counts.select(
            F.concat(pair_id(), suffix).alias("id"), *PAIR, "side", F.col("matches").alias("count")
        )
        .orderBy(F.desc("count"), "id")
        .limit(k)
    )


def search_absolute(
    index: DataFrame,
    means: DataFrame,
    k: int,
    opts: SketchOptions = SketchOptions(),
    *,
    query_size: int | None = None,
) -> DataFrame:
    """Top k by match count with the sign carried by the score.

    ``query_size`` is the sample size of the query when it differs from the
    index.
    """
    opts = SketchOptions(**{**opts.__dict__, "size": query_size or opts.size})
    counts = match_counts(index, means, opts)
    signed = F.when(F.col("side") == "+", F.col("matches")).otherwise(-F.col("matches"))
    return (
        counts.select(
            pair_id("_|_", "_|_").alias("id"),
            *PAIR,
            signed.alias("qcr_score"),
            F.col("matches").alias("abs_qcr_score"),
        )
        .orderBy(F.desc("abs_qcr_score"), "id", F.desc("qcr_score"))
        .limit(k)
    )


def search_counter(
    index: DataFrame,
    means: DataFrame,
    opts: SketchOptions = SketchOptions(),
    *,
    k: int = COUNTER_TOP,
    query_size: int = COUNTER_QUERY_SIZE,
) -> DataFrame:
    """Top ten sign-prefixed pair ids for a fixed query sample size."""
    opts = SketchOptions(**{**opts.__dict__, "size": query_size})
    counts = match_counts(index, means, opts)
    return (
        counts.select(
            F.concat("side", F.lit(":"), pair_id("_|_", "_|_")).alias("id"),
            F.col("matches").alias("count"),
        )
        .orderBy(F.desc("count"), "id")
        .limit(k)
    )
