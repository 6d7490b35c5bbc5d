"""Exact searches: full join on the key, joinability and Pearson r."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekin.functions.stats import guarded_pearson, pearson, score, t_statistic, two_sided_p
from lakekin.operators.pairs import (
    LakeSql,
    LakeTable,
    cell_pair_aggregate,
    lake_means,
)
from lakekin.options import CONTAINMENT_THRESHOLD, OVERLAP_TOP, PAIR
from lakekin.session import fits, materialize


def filter_keys(query: DataFrame, small_query: bool | None = None) -> DataFrame | None:
    """The query's keys for filtering lake rows by broadcast, or None.

    ``small_query`` skips the size probe; without it the keys are used only
    when they are proven to be few.
    """
    keys = query.select("key")
    if small_query is None:
        small_query = fits(keys)
    return keys if small_query else None


def search_exact(
    lake: Sequence[LakeTable], query: DataFrame, *, small_query: bool | None = None
) -> DataFrame:
    """Joinability and r of every lake pair against a query ``(key, value)``.

    All tables are searched in one plan. When the query is proven small (or
    declared so) its keys filter the tables before they are aggregated;
    otherwise the tables are aggregated first and the joined sides are both
    one row per key.
    """
    keys = filter_keys(query, small_query)
    return correlate(lake_means(lake, only_keys=keys), query)


def search_exact_cells(
    cells: DataFrame, query: DataFrame, *, small_query: bool | None = None, **rules
) -> DataFrame:
    """:func:`search_exact` over a tall lake; ``rules`` are its column rules.

    With a small query, tables without any of its keys are dropped before rows
    are assembled, and so are other keys. The tables that are left are written
    first: their list is then joined by its size, and the cells are not exchanged
    by table, which would put the largest table into one task.
    """
    keys = filter_keys(query, small_query)
    if keys is not None:
        few = F.broadcast(keys.withColumnRenamed("key", "cell"))
        matched = cells.join(few, "cell", "left_semi").select("table_id").distinct()
        matched = materialize(matched, "matched")
        if fits(matched):
            matched = F.broadcast(matched)
        cells = cells.join(matched, "table_id", "left_semi")
    means = cell_pair_aggregate(cells, F.avg("value").alias("value"), only_keys=keys, **rules)
    return correlate(means, query)


#: The columns that tell the pairs of a query table apart.
QUERY_PAIR = ["query_table", "query_key", "query_value"]


def search_exact_multi(lake: Sequence[LakeTable], queries: DataFrame) -> DataFrame:
    """:func:`search_exact` for every key and measure column of one or more query tables.

    ``queries`` are pair means; results carry :data:`QUERY_PAIR` beside the lake
    pair. All query pairs are searched in one pass over the lake.
    """
    probe = queries.select(
        *[F.col(a).alias(b) for a, b in zip(PAIR, QUERY_PAIR)], "key", F.col("value").alias("x")
    )
    totals = probe.groupBy(*QUERY_PAIR).agg(F.count("key").alias("total"))
    keys = filter_keys(probe.select("key").distinct())
    joined = lake_means(lake, only_keys=keys).withColumnRenamed("value", "y").join(probe, "key")
    found = joined.groupBy(*QUERY_PAIR, *PAIR).agg(
        F.count("y").alias("n"), guarded_pearson(F.col("x"), F.col("y")).alias("correlation")
    )
    shares = found.join(totals, QUERY_PAIR).withColumn("joinability", F.col("n") / F.col("total"))
    return shares.select(*QUERY_PAIR, *PAIR, "n", "joinability", "correlation")


def correlate(means: DataFrame, query: DataFrame) -> DataFrame:
    """Exact result rows from lake pair means and query means."""
    probe = query.select("key", F.col("value").alias("x"))
    joined = means.withColumnRenamed("value", "y").join(probe, "key")
    total = query.agg(F.count("key")).scalar()
    return (
        joined.groupBy(*PAIR)
        .agg(
            F.count("y").alias("n"),
            guarded_pearson(F.col("x"), F.col("y")).alias("correlation"),
        )
        .select(*PAIR, "n", (F.col("n") / total).alias("joinability"), "correlation")
    )


def exact_topk(result: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Top k exact results by ``score``."""
    ranked = result.withColumn("score", score(F.col("joinability"), F.col("correlation"), weight))
    # Rounded for the order only: equal scores must not be ranked by summing noise.
    return ranked.orderBy(F.desc_nulls_last(F.round("score", 9)), *PAIR).limit(k)


def distinct_keys(lake: Sequence[LakeTable], only_keys: DataFrame | None = None) -> DataFrame:
    """Distinct ``(table_id, key_col, position, key)`` of the lake, by one shuffle."""
    sql = LakeSql(lake, only_keys)
    return sql.run(
        f"SELECT {sql.table_id()} AS table_id, {sql.key_col()} AS key_col, "
        f"{sql.position()} AS position, key FROM (SELECT DISTINCT k, key FROM ({sql.keys_only()}))"
    )


def key_overlap(
    lake: Sequence[LakeTable], query: DataFrame, small_query: bool | None = None
) -> DataFrame:
    """Size of the intersection of distinct keys, per lake key column."""
    probe = query.select("key").where(F.col("key").isNotNull()).distinct()
    small = filter_keys(probe, small_query)
    keys = distinct_keys(lake, small)
    if small is None:
        keys = keys.join(probe, "key", "left_semi")
    return (
        keys
        .groupBy("table_id", "key_col", "position")
        .agg(F.count("*").alias("overlap"))
    )


def overlap_topk(
    lake: Sequence[LakeTable],
    query: DataFrame,
    k: int = OVERLAP_TOP,
    *,
    small_query: bool | None = None,
) -> DataFrame:
    """The k lake key columns sharing most distinct keys with the query."""
    return (
        key_overlap(lake, query, small_query)
        .orderBy(F.desc("overlap"), "table_id", "key_col")
        .limit(k)
        .select("table_id", "key_col", "overlap")
    )


def keyed_moments(lake: Sequence[LakeTable], only_keys: DataFrame | None = None) -> DataFrame:
    """Per key and pair: rows, and count, mean and variance of the measure; written once.

    One pass over the tables. Overlaps, shares and r all follow from these rows.
    """
    sql = LakeSql(lake, only_keys)
    parts = []
    for n in sql.measure_counts():
        numbers = range(1, n + 1)
        moments = ", ".join(
            f"count(m{j}) AS n{j}, avg(m{j}) AS a{j}, var_pop(m{j}) AS v{j}" for j in numbers
        )
        names = ", ".join(f"(n{j}, a{j}, v{j}) AS `{j}`" for j in numbers)
        parts.append(
            f"SELECT {sql.table_id()} AS table_id, {sql.key_col()} AS key_col, "
            f"{sql.value_col()} AS value_col, {sql.position()} AS position, key, rows, n, mean, spread "
            f"FROM (SELECT k, key, count(*) AS rows, {moments} "
            f"FROM ({sql.long_rows(n)}) GROUP BY k, key) "
            f"UNPIVOT INCLUDE NULLS ((n, mean, spread) FOR m IN ({names}))"
        )
    return materialize(sql.run(" UNION ALL ".join(parts)), "moments")


def centred(moments: DataFrame) -> DataFrame:
    """Moments with sum and square sum around the mean of the pair's key means.

    That makes the sums safe to subtract later and does not change r.
    """
    centres = moments.groupBy(*PAIR).agg(F.avg("mean").alias("centre"))
    moved = F.col("mean") - F.col("centre")
    return moments.join(centres, PAIR).select(
        *PAIR,
        "key",
        "rows",
        "n",
        (F.col("n") * moved).alias("s"),
        (F.col("n") * (F.col("spread") + moved * moved)).alias("ss"),
    )


def moment_overlap(moments: DataFrame, keys: DataFrame) -> DataFrame:
    """:func:`key_overlap` from moments that are written already."""
    own = moments.select("table_id", "key_col", "position", "key").distinct()
    shared = own.join(keys.distinct(), "key", "left_semi")
    return shared.groupBy("table_id", "key_col", "position").agg(F.count("*").alias("overlap"))


def overlap_rank_corr(
    lake: Sequence[LakeTable],
    query: LakeTable,
    k: int = OVERLAP_TOP,
    *,
    small_query: bool | None = None,
) -> DataFrame:
    """The k best overlapping key columns, ranked by \\|r\\| of the plain row join.

    The row join repeats every query row for every lake row of its key. Its
    size and r follow from per-key counts and sums of both sides, so the
    repeated rows are never made. ``query`` has one key and one measure.
    """
    ours = centred(keyed_moments([query])).select(
        "key",
        F.col("rows").alias("q_rows"),
        F.col("n").alias("q_n"),
        F.col("s").alias("q_s"),
        F.col("ss").alias("q_ss"),
    )
    query_keys = ours.select("key")
    measured = [t for t in lake if t.measures]
    moments = keyed_moments(measured, filter_keys(query_keys, small_query))
    overlaps = moment_overlap(moments, query_keys)
    if len(measured) < len(lake):
        # Tables of keys alone count among the best but have no r.
        others = [t for t in lake if not t.measures]
        overlaps = overlaps.unionByName(key_overlap(others, query_keys, small_query))
    best = overlaps.orderBy(F.desc("overlap"), "table_id", "key_col").limit(k)
    best = best.select("table_id", "key_col", "overlap")
    joined = centred(moments).join(best, ["table_id", "key_col"]).join(ours, "key")
    sums = joined.groupBy(*PAIR).agg(
        F.sum(F.col("rows") * F.col("q_rows")).alias("joinability"),
        F.max("overlap").alias("overlap"),
        *row_join_sums(),
    )
    return (
        sums.select(*PAIR, "overlap", "joinability", row_join_r().alias("correlation"))
        .orderBy(F.desc_nulls_last(F.abs("correlation")), *PAIR)
    )


def row_join_sums() -> list[Column]:
    """Sums over a row join, from counts and sums per key of both sides."""
    return [
        F.sum(F.col("n") * F.col("q_n")).cast("double").alias("w"),
        F.sum(F.col("n") * F.col("q_s")).alias("sx"),
        F.sum(F.col("q_n") * F.col("s")).alias("sy"),
        F.sum(F.col("s") * F.col("q_s")).alias("sxy"),
        F.sum(F.col("n") * F.col("q_ss")).alias("sxx"),
        F.sum(F.col("q_n") * F.col("ss")).alias("syy"),
    ]


def row_join_r() -> Column:
    """Pearson r of a row join from its :func:`row_join_sums`."""
    cov = F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")
    var_x = F.col("w") * F.col("sxx") - F.col("sx") * F.col("sx")
    var_y = F.col("w") * F.col("syy") - F.col("sy") * F.col("sy")
    defined = (var_x > 0) & (var_y > 0)
    return F.when(defined, F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y)))


def containment_first(
    lake: Sequence[LakeTable],
    query: DataFrame,
    *,
    threshold: float = CONTAINMENT_THRESHOLD,
    p_values: bool = False,
    small_query: bool | None = None,
) -> DataFrame:
    """Best key column per table by share of query keys, then r of its measures.

    ``query`` holds one row per key. Tables whose best share does not exceed
    ``threshold`` drop out; the first column wins ties.
    """
    total = query.agg(F.count_distinct("key")).scalar()
    keys = filter_keys(query, small_query)
    measured = [t for t in lake if t.measures]
    moments = keyed_moments(measured, keys)
    shares = moment_overlap(moments, query.select("key")).withColumn("containment", F.col("overlap") / total)
    best = shares.groupBy("table_id").agg(
        F.max(F.struct("containment", (-F.col("position")).alias("rank"), "key_col")).alias("b")
    )
    found = best.select("table_id", "b.key_col", "b.containment").where(F.col("containment") > threshold)
    probe = query.select("key", F.col("value").alias("x"))
    joined = (
        moments.where("n > 0")
        .withColumnRenamed("mean", "y")
        .join(found, ["table_id", "key_col"])
        .join(probe, "key")
    )
    result = joined.groupBy(*PAIR).agg(
        F.max("containment").alias("containment"),
        F.count("*").alias("n"),
        pearson(F.col("x"), F.col("y")).alias("correlation"),
    )
    if p_values:
        r, n = F.col("correlation"), F.col("n")
        result = result.withColumn(
            "p_value", two_sided_p(r, t_statistic(r, n), n.cast("double"))
        )
    return result
