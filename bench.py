"""Headline timings on the driver tables; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. Each query is run once to warm up and then
timed; its result goes to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekin.operators import exact, search
from lakekin.operators.index_store import TermStore
from lakekin.plans import queries as q
from lakekin.plans.lake_views import Lake
from lakekin.session import configure, new_folder

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    action()
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    # Index build over the whole lake, to files; then searches of that index.
    def build() -> TermStore:
        store = TermStore(spark, new_folder(spark, "bench-index"), q.OPTIONS)
        store.append_tables(Lake(spark, FOLDER).tables(), "all")
        return store

    seconds["index_build"] = timed(build)
    store = build()
    # A query arrives as a small table of its own.
    query_path = new_folder(spark, "bench-query")
    q.query_pairs(Lake(spark, FOLDER)).coalesce(1).write.parquet(query_path)

    def arriving() -> DataFrame:
        pairs = spark.read.schema("key string, value double").parquet(query_path)
        return q.query_means(pairs, "key", "value")

    def stored_search() -> None:
        query = arriving()
        run(search.search_signed(store.for_query(query), query, 10, q.OPTIONS))

    seconds["search_index"] = timed(stored_search)

    def exact_search() -> None:
        found = exact.search_exact(Lake(spark, FOLDER).tables(), arriving().select("key", "value"))
        run(exact.exact_topk(found, 10))

    seconds["search_exact"] = timed(exact_search)
    # A lake of very many small tables, as tall cells: one table per order.
    def order_cells() -> DataFrame:
        lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
        once = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
        column = lambda i, name, cell, num: F.struct(
            F.lit(i).alias("column_id"), F.lit(name).alias("column_name"), cell.alias("cell"), num.alias("num")
        )
        part = column(0, "part", F.concat(F.lit("part"), F.col("l_partkey").cast("string")), F.lit(None).cast("double"))
        price = column(1, "price", F.col("price").cast("string"), F.col("price"))
        cells = once.select(
            F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("table_id"),
            F.col("l_partkey").cast("long").alias("row_id"),
            F.explode(F.array(part, price)).alias("c"),
        )
        return cells.select("table_id", "row_id", "c.*")

    def many_build() -> TermStore:
        found = TermStore(spark, new_folder(spark, "bench-many"), q.OPTIONS)
        found.append_cells(order_cells(), "all")
        return found

    start = time.perf_counter()
    many = many_build()
    seconds["many_tables_build"] = round(time.perf_counter() - start, 3)
    many_tables = many.tables().count()
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_retailprice").cast("double").alias("value"),
    )
    many_query = q.query_means(parts, "key", "value")
    seconds["many_tables_search"] = timed(
        lambda: run(search.search_signed(many.for_query(many_query), many_query, 100, q.OPTIONS))
    )
    for name in (
        "pair_means",
        "term_index",
        "cell_term_index",
        "search_signed",
        "overlap_topk",
        "overlap_rank_corr",
        "containment_best",
        "search_quality",
        "augment_multi",
        "exact_split",
        "regression_metrics",
    ):
        seconds[name] = timed(lambda: run(q.REGISTRY[name](spark, FOLDER)))
    terms = store.terms()
    rows = terms.agg(F.count("*"), F.count_distinct("table_id", "key_col", "value_col")).first()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "index_rows": rows[0],
                "index_pairs": rows[1],
                "many_tables": many_tables,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
