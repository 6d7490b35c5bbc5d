"""Inverted index over the key columns of a tall lake, and the searches it answers.

The index has four tables: ``lists`` names, per key, the key columns that hold it and
in how many rows; ``rarity`` says how many columns hold a key; ``pairs`` lists the
column pairs; ``moments`` has count, mean and variance of a measure per pair and key.

A column that shares at least ``t`` of a query's ``m`` known keys must hold one of any
``m - t + 1`` of them. Searches take the rarest ones, whose lists are short: they name
the candidates, and only candidates are counted over all keys. The keys to take are cut
by a histogram of rarities, one row per rarity, so no query's keys are ever sorted in
one task. Any number of query columns is searched at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekin.functions.stats import pearson, t_statistic, two_sided_p
from lakekin.operators.exact import QUERY_PAIR, centred, row_join_r, row_join_sums
from lakekin.operators.pairs import NUMBERED, named_pairs, numbered_rows, quoted, role_columns
from lakekin.options import CONTAINMENT_THRESHOLD, OVERLAP_TOP, PAIR
from lakekin.session import materialize

QUERY = ["query_table", "query_key"]
COLUMN = ["table_id", "key_col"]
#: Share of a query's known keys whose columns give the first bound on the k-th overlap.
FIRST_SHARE = 0.125


class KeyIndex(NamedTuple):
    """The tables of an index."""

    lists: DataFrame
    rarity: DataFrame
    pairs: DataFrame
    moments: DataFrame


SCHEMAS = KeyIndex(
    "table_id string, key_col string, position int, key string, rows bigint",
    "key string, columns bigint",
    "table_id string, key_col string, value_col string",
    "table_id string, key_col string, value_col string, key string, n bigint, mean double, spread double",
)
#: What the files of each table are sorted by; the first column prunes a search's reads.
ORDERS = KeyIndex(["key", *COLUMN], ["key"], ["table_id"], [*PAIR, "key"])


def index_tables(cells: DataFrame, *, label_by: str = "name", **rules) -> KeyIndex:
    """The tables of an index as plans over written cells; ``rules`` are the column rules.

    Roles meet the cells before any exchange, so cells of other columns are dropped where
    they are read; keys ship their text and measures their number, and columns are named
    after the rows are counted.
    """
    columns = role_columns(cells, label_by=label_by, **rules)
    keyed = columns.where("is_key").select("table_no", "table_id", "column_id", F.col("label").alias("key_col"))
    keys = cells.where(F.col("cell").isNotNull()).select("table_id", "column_id", F.col("cell").alias("key"))
    keys = keys.join(keyed.drop("key_col"), ["table_id", "column_id"])
    counted = keys.groupBy("table_no", "column_id", "key").agg(F.count("*").alias("rows"))
    lists = counted.join(keyed, ["table_no", "column_id"])
    lists = lists.select(*COLUMN, F.col("column_id").alias("position"), "key", "rows")
    moments = [F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("spread")]
    moments = named_pairs(numbered_rows(cells, columns).groupBy(*NUMBERED, "key").agg(*moments), columns)
    measures = columns.where("NOT is_key").select("table_no", F.col("label").alias("value_col"))
    pairs = keyed.join(measures, "table_no").select(*PAIR)
    return KeyIndex(lists, lists.groupBy("key").agg(F.count("*").alias("columns")), pairs, moments)


def save_index(cells: DataFrame, path: str, *, parts: Sequence[str] = KeyIndex._fields, **rules) -> KeyIndex:
    """Write the index of written ``cells`` to ``path``, each table in its order.

    ``parts`` names the tables to write, for searches that need no other: overlaps come
    from ``lists`` and ``rarity`` alone. ``rarity`` needs ``lists``.
    """
    spark = cells.sparkSession
    tables = index_tables(cells, **rules)
    for name in KeyIndex._fields:
        if name not in parts:
            continue
        table = getattr(tables, name)
        if name == "rarity":
            # Counted from the lists as written, not from the cells again.
            lists = spark.read.schema(SCHEMAS.lists).parquet(f"{path}/lists")
            table = lists.groupBy("key").agg(F.count("*").alias("columns"))
        order = getattr(ORDERS, name)
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
    return load_index(spark, path, parts)


def load_index(spark: SparkSession, path: str, parts: Sequence[str] = KeyIndex._fields) -> KeyIndex:
    """The tables of a written index; those that are not among ``parts`` are None."""

    def table(name: str) -> DataFrame | None:
        if name in parts:
            return spark.read.schema(getattr(SCHEMAS, name)).parquet(f"{path}/{name}")

    return KeyIndex(*[table(n) for n in KeyIndex._fields])


def known_keys(index: KeyIndex, queries: DataFrame) -> DataFrame:
    """Written ``query_table, query_key, key, q_rows, columns`` of the keys that the lake holds.

    ``queries`` are keyed moments of query tables (see :func:`exact.keyed_moments`).
    """
    own = queries.where(F.col("key").isNotNull()).groupBy(F.col("table_id").alias("query_table"), F.col("key_col").alias("query_key"), "key")
    own = own.agg(F.max("rows").alias("q_rows"))
    return materialize(own.join(index.rarity, "key"), "known-keys")


def rarest(known: DataFrame, needed: DataFrame) -> DataFrame:
    """At least the ``need`` rarest keys of every query: all up to the rarity that reaches it."""
    classes = known.groupBy(*QUERY, "columns").agg(F.count("*").alias("keys"))
    upto = F.sum("keys").over(Window.partitionBy(*QUERY).orderBy("columns").rowsBetween(Window.unboundedPreceding, -1))
    opened = classes.withColumn("before", F.coalesce(upto, F.lit(0))).join(needed, QUERY).where("before < need")
    limits = opened.groupBy(*QUERY).agg(F.max("columns").alias("limit"))
    return known.join(limits, QUERY).where("columns <= limit").select(*QUERY, "key")


def candidates(index: KeyIndex, prefix: DataFrame) -> DataFrame:
    """The columns on the lists of a query's prefix keys."""
    return index.lists.select(*COLUMN, "key").join(prefix, "key").select(*QUERY, *COLUMN).distinct()


def overlaps(index: KeyIndex, known: DataFrame, found: DataFrame) -> DataFrame:
    """Exact ``overlap`` and ``joinability`` (rows of the row join) of candidate columns only."""
    lists = index.lists.join(found.select(*COLUMN).distinct(), COLUMN, "left_semi")
    shared = lists.join(known.select(*QUERY, "key", "q_rows"), "key").groupBy(*QUERY, *COLUMN, "position")
    # Counted in each task before the exchange, so a column with most keys is no hot spot.
    counted = shared.agg(F.count("*").alias("overlap"), F.sum(F.col("rows") * F.col("q_rows")).alias("joinability"))
    return counted.join(found, [*QUERY, *COLUMN], "left_semi")


def best_columns(found: DataFrame, k: int) -> DataFrame:
    """The first k columns per query by overlap, then by name."""
    order = Window.partitionBy(*QUERY).orderBy(F.desc("overlap"), *COLUMN)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def overlap_topk_cells(index: KeyIndex, queries: DataFrame, k: int = OVERLAP_TOP) -> DataFrame:
    """The k lake key columns sharing most distinct keys with each query key column.

    Two rounds are enough. The columns on the lists of the rarest eighth of the keys are
    counted; their k-th overlap bounds the true one from below, and with it the keys that
    must be looked at. Columns outside those lists cannot reach the k-th place.
    """
    known = known_keys(index, queries)
    sizes = known.groupBy(*QUERY).agg(F.count("*").alias("known"))
    first = sizes.withColumn("need", F.ceil(F.col("known") * FIRST_SHARE))
    seen = best_columns(overlaps(index, known, candidates(index, rarest(known, first))), k)
    bound = seen.where(F.col("place") == k).select(*QUERY, F.col("overlap").alias("bound"))
    bound = materialize(bound, "bounds")
    needed = sizes.join(bound, QUERY, "left").withColumn("need", F.col("known") - F.coalesce("bound", F.lit(1)) + 1)
    found = materialize(candidates(index, rarest(known, needed)), "candidates")
    best = best_columns(overlaps(index, known, found), k)
    return materialize(best.select(*QUERY, *COLUMN, "position", "overlap", "joinability"), "best")


def overlap_rank_corr_cells(index: KeyIndex, queries: DataFrame, k: int = OVERLAP_TOP) -> DataFrame:
    """The measures beside the k best overlapping columns of each query key, by \\|r\\| of the row join.

    Every measure of the query is ranked. Only moments of the best columns are read further.
    """
    best = overlap_topk_cells(index, queries, k)
    ours = centred(queries).select(
        *[F.col(a).alias(b) for a, b in zip(PAIR, QUERY_PAIR)],
        "key",
        F.col("n").alias("q_n"),
        F.col("s").alias("q_s"),
        F.col("ss").alias("q_ss"),
    )
    moments = index.moments.join(best.select(*COLUMN).distinct(), COLUMN, "left_semi")
    theirs = centred(moments.withColumn("rows", F.col("n")))
    joined = theirs.join(ours, "key").join(best.select(*QUERY, *COLUMN), [*QUERY, *COLUMN], "left_semi")
    sums = joined.groupBy(*QUERY_PAIR, *PAIR).agg(*row_join_sums())
    measures = queries.select(*[F.col(a).alias(b) for a, b in zip(PAIR, QUERY_PAIR)]).distinct()
    listed = best.join(measures, QUERY).join(index.pairs, COLUMN)
    ranked = listed.join(sums, [*QUERY_PAIR, *PAIR], "left")
    return ranked.select(*QUERY_PAIR, *PAIR, "overlap", "joinability", row_join_r().alias("correlation"))


def containment_first_cells(
    index: KeyIndex, queries: DataFrame, *, threshold: float = CONTAINMENT_THRESHOLD, p_values: bool = False
) -> DataFrame:
    """Best key column per query key and table by share of the query's keys, then r of its measures.

    A share above the threshold asks for so many common keys that only the rarest keys,
    beyond that number, need to be looked up. r is over the means per key of both sides.
    """
    known = known_keys(index, queries)
    named = queries.where(F.col("key").isNotNull()).select(*[F.col(a).alias(b) for a, b in zip(PAIR, QUERY_PAIR)], "key", F.col("n").alias("q_n"), F.col("mean").alias("x"))
    totals = named.groupBy(*QUERY).agg(F.count_distinct("key").alias("total"))
    sizes = known.groupBy(*QUERY).agg(F.count("*").alias("known")).join(totals, QUERY)
    least = F.floor(F.col("total") * threshold) + 1
    needed = sizes.withColumn("need", F.col("known") - least + 1).where("need > 0")
    found = materialize(candidates(index, rarest(known, needed)), "candidates")
    shares = overlaps(index, known, found).join(totals, QUERY).withColumn("containment", F.col("overlap") / F.col("total"))
    shares = shares.where(F.col("containment") > threshold)
    rank: Column = F.struct("containment", (-F.col("position")).alias("rank"), "key_col")
    best = shares.groupBy(*QUERY, "table_id").agg(F.max(rank).alias("b"))
    best = materialize(best.select(*QUERY, "table_id", "b.key_col", "b.containment"), "best")
    moments = index.moments.join(best.select(*COLUMN).distinct(), COLUMN, "left_semi")
    joined = moments.withColumnRenamed("mean", "y").join(named.where("q_n > 0"), "key").join(best, [*QUERY, *COLUMN])
    result = joined.groupBy(*QUERY_PAIR, *PAIR).agg(
        F.max("containment").alias("containment"),
        F.count("*").alias("n"),
        pearson(F.col("x"), F.col("y")).alias("correlation"),
    )
    if p_values:
        r, n = F.col("correlation"), F.col("n")
        result = result.withColumn("p_value", two_sided_p(r, t_statistic(r, n), n.cast("double")))
    return result


def index_means(index: KeyIndex) -> DataFrame:
    """Pair means of the lake, the input of exact searches and sketches."""
    return index.moments.select(*PAIR, "key", F.col("mean").alias("value"))


def augment_hits_cells(base: DataFrame, base_key: str, index: KeyIndex, hits: DataFrame, k: int, skip_first: int = 0) -> DataFrame:
    """Left join the per-key means of the hits numbered 1..k, without the first ``skip_first``.

    Nothing of the hits comes to the driver: the moments of the named pairs are pivoted by
    place. Base rows and their number stay.
    """
    places = range(skip_first + 1, k + 1)
    chosen = hits.where(F.col("place").between(skip_first + 1, k)).select("place", *PAIR)
    columns = [F.max(F.when(F.col("place") == p, F.col("mean"))).alias(f"hit_{p}") for p in places]
    wide = index.moments.join(chosen, PAIR).groupBy(F.col("key").alias("__key")).agg(*columns or [F.count("*").alias("__n")])
    joined = base.join(wide, quoted(base_key) == F.col("__key"), "left")
    return joined.select(*[quoted(c) for c in base.columns], *[f"hit_{p}" for p in places])
