"""One runnable query per operator, over the driver tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekin.operators import augment, evaluate, exact, gram, key_index, models, pairs, profile, search, sketch, split
from lakekin.operators.index_store import TermStore, append_terms
from lakekin.operators.mapper import map_blocks
from lakekin.operators.pairs import (
    LakeTable,
    cell_pair_means,
    lake_means,
    query_means,
    sketch_candidates,
    sketch_means,
)
from lakekin.operators.sketch_store import SketchStore
from lakekin.options import COMPAT_MIN_ROWS, PAIR, SketchOptions
from lakekin.plans.lake_views import CELL_VIEWS, Lake
from lakekin.session import materialize, new_folder
from lakekin.sources import cells as tall
from lakekin.sources import files as lake_files
from lakekin.streaming.index_stream import index_stream as start_index_stream
from lakekin.streaming.table_stream import ARRIVING_SCHEMA, index_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERY_TABLE = "cust_order_totals"
QUERY_PAIR = ("c_name", "order_total")
MULTI_QUERY = ("customer", "part")
# Means of different engines may differ in the last bit; do not label by that bit.
OPTIONS = SketchOptions(rel_eps=1e-9)

REGISTRY: dict[str, Query] = {}


def register(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def options(**changes) -> SketchOptions:
    return SketchOptions(**{**OPTIONS.__dict__, **changes})


def full_means(lake: Lake) -> DataFrame:
    return lake_means(lake.tables())


def sampled_means(lake: Lake, opts: SketchOptions = OPTIONS) -> DataFrame:
    """:func:`full_means` without the keys that no sketch by ``opts`` can hold."""
    return sketch_means(lake.tables(), opts)


def the_query(lake: Lake) -> DataFrame:
    """Customers and their order totals: the query table of the searches."""
    return query_means(lake.table(QUERY_TABLE).df, *QUERY_PAIR)


def query_pairs(lake: Lake) -> DataFrame:
    """The query as ``(key, value)``: a small table of its own, written once."""
    return materialize(the_query(lake).select("key", "value"), "query")


def lake_cell_rows(lake: Lake) -> DataFrame:
    parts = []
    for table_id, (view, columns) in CELL_VIEWS.items():
        parts.append(
            tall.cells_from_wide(
                lake.sql(view), table_id, F.col("row_id"), [name for name, _ in columns]
            )
        )
    return tall.union_cells(parts)


def written_cells(lake: Lake) -> DataFrame:
    """The tall lake as files: the searches and indexes read it several times."""
    return materialize(lake_cell_rows(lake), "cells")


def customer_blocks(lake: Lake, size: int) -> DataFrame:
    """Blocks of ``size`` customers, each standing for one file of a lake."""
    return lake.sql(
        "SELECT c_custkey DIV "
        f"{size} AS block, array_sort(collect_list(named_struct('id', c_custkey, 'c_name', c_name, "
        "'c_mktsegment', c_mktsegment, 'acctbal', "
        "CAST(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS STRING)))) AS rows "
        "FROM {customer} GROUP BY 1"
    )


def csv_files(lake: Lake) -> DataFrame:
    """Small CSV tables made of the customers, as ``(path, content)``."""
    line = F.transform("rows", lambda r: F.concat_ws(";", r.c_name, r.c_mktsegment, r.acctbal))
    text = F.concat(F.lit("c_name;c_mktsegment;acctbal\n"), F.array_join(line, "\n"))
    path = F.concat(F.lit("cust_"), F.lpad(F.col("block").cast("string"), 8, "0"), F.lit(".csv"))
    return customer_blocks(lake, 50).select(path.alias("path"), text.cast("binary").alias("content"))


# ---------------------------------------------------------------- sources


@register
def lake_cells(spark: SparkSession, folder: str) -> DataFrame:
    return lake_cell_rows(Lake(spark, folder))


@register
def clean_keys(spark: SparkSession, folder: str) -> DataFrame:
    return tall.clean_cells(lake_cell_rows(Lake(spark, folder)))


@register
def csv_lake_cells(spark: SparkSession, folder: str) -> DataFrame:
    return lake_files.csv_cells(csv_files(Lake(spark, folder))).cells


@register
def archive_tables(spark: SparkSession, folder: str) -> DataFrame:
    def pack(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            packed = []
            for block, rows in zip(batch["block"], batch["rows"]):
                columns = {
                    "c_name": [r["c_name"] for r in rows],
                    "c_mktsegment": [r["c_mktsegment"] for r in rows],
                    "acctbal": [int(r["acctbal"]) for r in rows],
                }
                entry, archive = io.BytesIO(), io.BytesIO()
                pq.write_table(pa.table(columns), entry)
                with zipfile.ZipFile(archive, "w") as out:
                    out.writestr(f"part_{block:08d}.parquet", entry.getvalue())
                    out.writestr("readme.txt", "not a table")
                packed.append(("customers'.zip", archive.getvalue()))
            yield pd.DataFrame(packed, columns=["path", "content"])

    blocks = customer_blocks(Lake(spark, folder), 50)
    return lake_files.archive_cells(blocks.mapInPandas(pack, "path string, content binary")).cells


@register
def relation_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Web tables as JSON lines; each is stored by column, so it gets transposed."""
    blocks = customer_blocks(Lake(spark, folder), 20)

    def column(name: str):
        return F.concat(F.array(F.lit(name)), F.transform("rows", lambda r: r[name]))

    lines = blocks.select(
        F.format_string("dwtc-%03d_%d", F.lit(7), F.col("block")).alias("table_id"),
        F.to_json(
            F.struct(
                F.array(column("c_name"), column("c_mktsegment"), column("acctbal")).alias("relation")
            )
        ).alias("value"),
    )
    return lake_files.relation_cells(lake_files.parse_relations(lines))


@register
def rebuild_table(spark: SparkSession, folder: str) -> DataFrame:
    return tall.rebuild_table(lake_cell_rows(Lake(spark, folder)), "customer", 3)


# --------------------------------------------------------------- profiles


@register
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_profile(lake_cell_rows(Lake(spark, folder)))


@register
def column_profile_dtype(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_profile(lake_cell_rows(Lake(spark, folder)), rule="dtype")


@register
def column_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_pairs(lake_cell_rows(Lake(spark, folder)), min_rows=COMPAT_MIN_ROWS)


@register
def table_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_stats(lake_cell_rows(Lake(spark, folder)))


@register
def map_tables(spark: SparkSession, folder: str) -> DataFrame:
    def shape(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_rows": [len(table)], "n_columns": [len(table.columns)]})

    results, _ = map_blocks(
        lake_cell_rows(Lake(spark, folder)),
        shape,
        "n_rows bigint, n_columns bigint",
        combine=[F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns")],
        block_rows=5_000,
    )
    return results


# ------------------------------------------------------ sketches and index


@register
def pair_means(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(full_means(Lake(spark, folder)), "value")


@register
def cell_pair_means_strict(spark: SparkSession, folder: str) -> DataFrame:
    cells = written_cells(Lake(spark, folder))
    return rounded(cell_pair_means(cells, min_rows=COMPAT_MIN_ROWS), "value")


@register
def cell_pair_means_dtype(spark: SparkSession, folder: str) -> DataFrame:
    cells = written_cells(Lake(spark, folder))
    return rounded(cell_pair_means(cells, rule="dtype", min_rows=COMPAT_MIN_ROWS), "value")


@register
def cell_term_index(spark: SparkSession, folder: str) -> DataFrame:
    cells = written_cells(Lake(spark, folder))
    return sketch.term_index(cell_pair_means(cells, min_rows=COMPAT_MIN_ROWS), OPTIONS)


@register
def pair_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sketch.pair_sketch(sampled_means(Lake(spark, folder)), OPTIONS), "value")


@register
def pair_sketch_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    """The same sketches without shuffling keys that cannot be sampled."""
    # The views join large tables; both passes read their rows, joined once and written.
    lake = [replace(t, df=materialize(t.df, t.table_id)) for t in Lake(spark, folder).tables()]
    means = sketch_candidates(lake, OPTIONS.size)
    return rounded(sketch.pair_sketch(means, OPTIONS), "value")


def _small_sketch(spark: SparkSession, folder: str, order: str) -> DataFrame:
    opts = options(hash_order=order)
    kept = sketch.pair_sketch(sampled_means(Lake(spark, folder), opts), opts)
    return kept.select(*PAIR, "key", "sketch_rank")


@register
def pair_sketch_sha2(spark: SparkSession, folder: str) -> DataFrame:
    return _small_sketch(spark, folder, "sha2")


@register
def pair_sketch_le_signed(spark: SparkSession, folder: str) -> DataFrame:
    return _small_sketch(spark, folder, "le_signed")


@register
def term_index(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.term_index(sampled_means(Lake(spark, folder)), OPTIONS)


def _small_index(spark: SparkSession, folder: str, **changes) -> DataFrame:
    opts = options(**changes)
    return sketch.term_index(sampled_means(Lake(spark, folder), opts), opts)


@register
def term_index_hex(spark: SparkSession, folder: str) -> DataFrame:
    return _small_index(spark, folder, term="hex")


@register
def term_index_inner(spark: SparkSession, folder: str) -> DataFrame:
    return _small_index(spark, folder, inner_hash=True)


@register
def term_index_sql_label(spark: SparkSession, folder: str) -> DataFrame:
    return _small_index(spark, folder, label="sql")


@register
def index_append(spark: SparkSession, folder: str) -> DataFrame:
    """Index half of the lake, then append all of it: nothing is counted twice."""
    lake = Lake(spark, folder)
    half = sketch.term_index(sketch_means(lake.tables()[::2], OPTIONS), OPTIONS)
    return append_terms(half, sketch.term_index(sampled_means(lake), OPTIONS))


@register
def index_store(spark: SparkSession, folder: str) -> DataFrame:
    """The same through files: two batches, the second one written twice."""
    lake = Lake(spark, folder)
    store = TermStore(spark, new_folder(spark, "index"), OPTIONS)
    store.append_tables(lake.tables()[::2], "first")
    for _ in range(2):
        store.append_tables(lake.tables(), "second")
    return store.terms()


@register
def index_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The tall lake in three parts, rows dealt by number; the second part comes twice."""
    lake = Lake(spark, folder)
    cells = written_cells(lake)
    store = SketchStore(spark, new_folder(spark, "merged-index"), OPTIONS, min_rows=COMPAT_MIN_ROWS)
    for part in (0, 1, 1, 2):
        store.append_cells(cells.where(F.col("row_id") % 3 == part), f"part-{part}")
    return store.terms()


@register
def index_merge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as one table that arrives in many files."""
    arriving = new_folder(spark, "arriving")
    lake = Lake(spark, folder)
    files = csv_files(lake).withColumn("path", F.concat(F.lit("customers/"), "path"))
    files.repartition(4).write.parquet(arriving)
    store = SketchStore(spark, new_folder(spark, "stream-index"), OPTIONS)
    stream = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 2).parquet(arriving)
    query = start_index_stream(stream, store, new_folder(spark, "stream-state"), decode=folder_tables)
    query.awaitTermination()
    return store.terms()


@register
def index_table_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all tables of the tall lake as a stream; the tables end before their last rows come."""
    cells = written_cells(Lake(spark, folder))
    rows = pairs.cell_pair_rows(cells, min_rows=COMPAT_MIN_ROWS)
    rows = materialize(rows.withColumn("ended", F.lit(False)), "pair-rows")
    part = F.pmod(F.xxhash64("key", "value"), F.lit(3))
    ends = rows.select("table_id", F.lit(True).alias("ended")).distinct()
    arriving = new_folder(spark, "arriving")
    for n in range(3):
        batch = rows.where(part == n)
        if n == 1:
            batch = batch.unionByName(ends, allowMissingColumns=True)
        batch.write.mode("append").parquet(arriving)
        if n == 0:
            # As many files as tasks wrote; a trigger takes one such third.
            files = len(spark.read.schema(ARRIVING_SCHEMA).parquet(arriving).inputFiles())
    store = SketchStore(spark, new_folder(spark, "table-index"), OPTIONS)
    stream = spark.readStream.schema(ARRIVING_SCHEMA).option("maxFilesPerTrigger", files).parquet(arriving)
    index_tables(stream, store, new_folder(spark, "stream-state"), salts=8).awaitTermination()
    return store.terms()


def folder_tables(files: DataFrame) -> tall.CellSource:
    """Numbered CSV files as parts of one table; its rows are numbered by file and line."""
    found = lake_files.csv_cells(files)
    row = F.regexp_extract("table_id", r"(\d+)$", 1).cast("long") * (1 << 32) + F.col("row_id")
    return found._replace(cells=found.cells.withColumns({"row_id": row, "table_id": F.lit("customers")}))


@register
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    terms = sketch.term_index(sampled_means(Lake(spark, folder)), OPTIONS)
    return rounded(sketch.index_stats(terms), "mean_prefix", digits=4)


@register
def inverted_lists(spark: SparkSession, folder: str) -> DataFrame:
    terms = sketch.term_index(sampled_means(Lake(spark, folder)), OPTIONS)
    lists = sketch.inverted_lists(terms)
    return lists.select("term", F.size("pairs").cast("long").alias("n_pairs"))


@register
def index_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files arrive as a stream; the index is read when all have been taken."""
    arriving = new_folder(spark, "arriving")
    csv_files(Lake(spark, folder)).write.parquet(arriving)
    store = TermStore(spark, new_folder(spark, "stream-index"), OPTIONS)
    stream = spark.readStream.schema("path string, content binary").parquet(arriving)
    query = start_index_stream(stream, store, new_folder(spark, "stream-state"))
    query.awaitTermination()
    return store.terms()


# --------------------------------------------------------------- searches


def lake_index(lake: Lake, **changes) -> DataFrame:
    opts = options(**changes)
    return sketch.term_index(sampled_means(lake, opts), opts)


@register
def search_signed(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    return search.search_signed(lake_index(lake), the_query(lake), 10, OPTIONS)


@register
def search_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The search against an index on disk, with its terms pushed into the scan."""
    lake = Lake(spark, folder)
    store = TermStore(spark, new_folder(spark, "index"), OPTIONS)
    store.append_tables(lake.tables(), "all")
    query = the_query(lake)
    return search.search_signed(store.for_query(query), query, 10, OPTIONS)


@register
def search_multi(spark: SparkSession, folder: str) -> DataFrame:
    """A query table with two measures; the terms of both are pooled."""
    lake = Lake(spark, folder)
    query = lake_means([lake.table(QUERY_TABLE)])
    return search.search_signed(lake_index(lake), query, 10, OPTIONS)


@register
def search_multi_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Query tables with several key columns and measures against an index on disk."""
    lake = Lake(spark, folder)
    store = TermStore(spark, new_folder(spark, "index"), OPTIONS)
    store.append_tables(lake.tables(), "all")
    query = lake_means(lake.tables(MULTI_QUERY))
    return search.search_signed(store.for_query(query), query, 10, OPTIONS)


@register
def search_abs(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    return search.search_absolute(lake_index(lake), the_query(lake), 10, OPTIONS, query_size=64)


@register
def search_counter(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    return search.search_counter(lake_index(lake), the_query(lake), OPTIONS)


# -------------------------------------------------------- exact, quality


@register
def exact_corr(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = exact.search_exact(lake.tables(), query_pairs(lake))
    return rounded(found, "joinability", "correlation")


@register
def exact_corr_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean text length by document source, searched in the tall lake."""
    lake = Lake(spark, folder)
    query = query_means(lake.read("documents"), "source", "n_chars").select("key", "value")
    cells = written_cells(lake)
    found = exact.search_exact_cells(cells, query, min_rows=COMPAT_MIN_ROWS)
    return rounded(found, "joinability", "correlation")


@register
def exact_corr_multi(spark: SparkSession, folder: str) -> DataFrame:
    """Every key and measure column of two query tables against the whole lake."""
    lake = Lake(spark, folder)
    found = exact.search_exact_multi(lake.tables(), lake_means(lake.tables(MULTI_QUERY)))
    return rounded(found, "joinability", "correlation")


@register
def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = exact.exact_topk(exact.search_exact(lake.tables(), query_pairs(lake)), 10)
    return rounded(found, "joinability", "correlation", "score")


@register
def exact_topk_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation counts three times as much as joinability."""
    lake = Lake(spark, folder)
    found = exact.exact_topk(exact.search_exact(lake.tables(), query_pairs(lake)), 5, weight=0.75)
    return rounded(found, "joinability", "correlation", "score")


@register
def overlap_topk(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    return exact.overlap_topk(lake.tables(), query_pairs(lake))


@register
def overlap_rank_corr(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    query = LakeTable("query", query_pairs(lake), ("key",), ("value",))
    return rounded(exact.overlap_rank_corr(lake.tables(), query), "correlation")


@register
def containment_best(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = exact.containment_first(lake.tables(), query_pairs(lake), p_values=True)
    return rounded(found, "containment", "correlation", "p_value")


@register
def search_quality(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    means = materialize(full_means(lake), "means")
    query = the_query(lake)
    found = search.search_signed(sketch.term_index(means, OPTIONS), query, 10, OPTIONS)
    truth = materialize(exact.exact_topk(exact.correlate(means, query), 10), "truth")
    return rounded(evaluate.search_quality(truth, found), "precision", "recall", "f1")


@register
def quality_grid(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    means = materialize(full_means(lake), "means")
    query = the_query(lake)
    truth = materialize(exact.exact_topk(exact.correlate(means, query), 8), "truth")
    grid = evaluate.quality_grid(means, query, truth, 8, opts=OPTIONS)
    return rounded(grid, "precision", "recall", "f1")


# ------------------------------------------------- searches of the tall lake

#: Query tables of the tall searches, each with all its key and measure columns.
TALL_QUERY = ("docs", "customer")


def stored_keys(lake: Lake, *parts: str) -> key_index.KeyIndex:
    """The inverted key index of the tall lake, written to files: all of it, or the parts a search needs."""
    cells = written_cells(lake)
    return key_index.save_index(cells, new_folder(lake.spark, "key-index"), min_rows=COMPAT_MIN_ROWS, parts=parts or key_index.KeyIndex._fields)


def tall_queries(lake: Lake) -> DataFrame:
    return exact.keyed_moments(lake.tables(TALL_QUERY))


@register
def key_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The posting lists as stored, with the rarity of each key."""
    index = stored_keys(Lake(spark, folder), "lists", "rarity")
    return index.lists.join(index.rarity, "key")


@register
def overlap_topk_cells(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = key_index.overlap_topk_cells(stored_keys(lake, "lists", "rarity"), tall_queries(lake), 2)
    return found.select("query_table", "query_key", "table_id", "key_col", "overlap", "joinability")


@register
def overlap_rank_corr_cells(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = key_index.overlap_rank_corr_cells(stored_keys(lake), tall_queries(lake), 2)
    return rounded(found, "correlation")


@register
def containment_best_cells(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    found = key_index.containment_first_cells(stored_keys(lake), tall_queries(lake), p_values=True)
    return rounded(found, "containment", "correlation", "p_value")


@register
def augment_multi_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the best columns for their source's mean length, the first (leaking) one left out."""
    lake = Lake(spark, folder)
    index = stored_keys(lake)
    query = query_means(lake.read("documents"), "source", "n_chars").select("key", "value")
    top = exact.exact_topk(exact.correlate(key_index.index_means(index), query), 4)
    hits = augment.ranked_hits(materialize(top, "hits"), "score", 4)
    base = lake.read("documents").select("doc_id", "source")
    joined = key_index.augment_hits_cells(base, "source", index, hits, 4, skip_first=1)
    return rounded(joined, "hit_2", "hit_3", "hit_4")


# ---------------------------------------------------------- use of results


@register
def augment_mean(spark: SparkSession, folder: str) -> DataFrame:
    lake = Lake(spark, folder)
    base = lake.read("customer").select("c_custkey", "c_name")
    orders = lake.table("cust_orders").df
    return augment.augment_mean(base, "c_name", orders, "c_name", "totalprice", "mean_price")


def best_hits(lake: Lake, k: int) -> DataFrame:
    """The k best pairs for the query outside its own table, numbered."""
    others = sketch.term_index(sketch_means([t for t in lake.tables() if t.table_id != QUERY_TABLE], OPTIONS), OPTIONS)
    found = search.search_signed(others, the_query(lake), 10, OPTIONS)
    return augment.ranked_hits(found, "count", k)


def augmented_query(lake: Lake, k: int) -> DataFrame:
    base = query_pairs(lake).withColumnsRenamed({"key": "c_name", "value": "order_total"})
    return augment.augment_hits(base, "c_name", lake.tables(), best_hits(lake, k), k)


@register
def augment_multi(spark: SparkSession, folder: str) -> DataFrame:
    joined = augmented_query(Lake(spark, folder), 5)
    return rounded(joined, *[f"hit_{p}" for p in range(1, 6)])


@register
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    customers = Lake(spark, folder).read("customer").select("c_custkey")
    return split.hash_split(customers, F.col("c_custkey"), seed=7)


@register
def exact_split(spark: SparkSession, folder: str) -> DataFrame:
    customers = Lake(spark, folder).read("customer").select("c_custkey")
    return split.exact_split(customers, F.col("c_custkey"), seed=7)


@register
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals predicted by the mean of the segment, of the nation, and of all."""
    lake = Lake(spark, folder)
    scale = 1e8
    base = lake.sql(
        "SELECT c.c_name, c_mktsegment, n_name, CAST(order_total AS DOUBLE) AS y FROM {totals} t "
        "JOIN {customer} c ON t.c_name = c.c_name JOIN {nation} ON c_nationkey = n_nationkey",
        totals=lake.table(QUERY_TABLE).df,
    )

    def config(name: str, key: str) -> DataFrame:
        return augment.augment_mean(base, key, base, key, "y", "p").select(
            F.lit(name).alias("config"), (F.col("y") / scale).alias("y"), (F.col("p") / scale).alias("p")
        )

    overall = base.withColumn("p", base.agg(F.avg("y")).scalar()).select(
        F.lit("overall").alias("config"), (F.col("y") / scale).alias("y"), (F.col("p") / scale).alias("p")
    )
    predictions = (
        config("by_segment", "c_mktsegment").unionByName(config("by_nation", "n_name")).unionByName(overall)
    )
    metrics = evaluate.regression_metrics(predictions, "y", "p")
    return rounded(metrics, "rmse", "mse", "mae", "r2", "pearson", "median_ae")


# ----------------------------------------------------- model evaluation


FEATURES = ["acctbal", "hit_1", "hit_2"]


def model_rows(lake: Lake) -> DataFrame:
    """Customers with their order total, segment and the two best found columns, split 90/10.

    Written once: training makes many passes over it.
    """
    joined = augmented_query(lake, 2)
    customers = lake.sql(
        "SELECT c_custkey, c_name AS name, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS acctbal FROM {customer}"
    )
    rows = joined.join(customers, joined["c_name"] == customers["name"]).select(
        "c_custkey",
        "c_mktsegment",
        "acctbal",
        (F.col("order_total") / 1e8).alias("order_total"),
        "hit_1",
        "hit_2",
    )
    return materialize(split.hash_split(rows, F.col("c_custkey")), "model-rows")


def _model(rows: DataFrame):
    train = rows.where(F.col("split") == "train")
    return models.train_regressor(train, "order_total", FEATURES, ["c_mktsegment"])


@register
def train_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Test error with none, one and two found columns added."""
    rows = model_rows(Lake(spark, folder))
    configurations = {f"added_{i}": FEATURES[: 1 + i] for i in range(3)}
    return models.train_eval(
        rows, "order_total", configurations, ["c_mktsegment"]
    )


@register
def perm_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = model_rows(Lake(spark, folder))
    test = rows.where(F.col("split") == "test")
    return models.permutation_importance(
        _model(rows), test, F.col("c_custkey"), "order_total", FEATURES, ["c_mktsegment"]
    )


@register
def ice_curves(spark: SparkSession, folder: str) -> DataFrame:
    rows = model_rows(Lake(spark, folder))
    test = rows.where(F.col("split") == "test")
    return models.ice_curves(
        _model(rows), test, F.col("c_custkey"), "hit_1", centered=True
    )


@register
def pdp_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = model_rows(Lake(spark, folder))
    test = rows.where(F.col("split") == "test")
    return models.pdp_curve(
        models.ice_curves(_model(rows), test, F.col("c_custkey"), "hit_1")
    )


LINE_FEATURES = ("n_orders", "n_items")


def line_rows(lake: Lake) -> DataFrame:
    """Customers with order total (label), order and item counts, split 90/10."""
    rows = lake.sql(
        "SELECT c_custkey, CAST(n_orders AS DOUBLE) AS n_orders, CAST(n_items AS DOUBLE) AS n_items, "
        "order_total / 1e8 AS y FROM {orders_by} o JOIN {items_by} i ON o.c_name = i.c_name "
        "JOIN {customer} c ON o.c_name = c.c_name",
        orders_by=lake.table("cust_order_totals").df,
        items_by=lake.table("cust_item_totals").df,
    )
    return split.hash_split(rows, F.col("c_custkey"), seed=7)


def _line_model(lake: Lake) -> tuple[models.FittedModel, DataFrame]:
    """Least squares on two features, which plain SQL can repeat, and the test rows."""
    rows = materialize(line_rows(lake), "line-rows")
    model = models.train_regressor(rows.where(F.col("split") == "train"), "y", LINE_FEATURES, linear=True)
    return model, rows.where(F.col("split") == "test").drop("split")


@register
def train_eval_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Test error of least squares with one and with both features."""
    rows = materialize(line_rows(Lake(spark, folder)), "line-rows")
    configurations = {"one": LINE_FEATURES[:1], "both": LINE_FEATURES}
    metrics = models.train_eval(rows, "y", configurations, linear=True)
    return rounded(metrics, "rmse", "mse", "mae", "r2", "pearson", "median_ae")


@register
def model_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares on orders and on their means per customer, with 0 to 5 found columns, with and without the first."""
    lake = Lake(spark, folder)
    orders = lake.sql(
        "SELECT t.c_name, CAST(totalprice AS DOUBLE) / 1e7 AS y, CAST(c_acctbal AS DOUBLE) AS acctbal "
        "FROM {orders} t JOIN {customer} c ON t.c_name = c.c_name",
        orders=lake.table("cust_orders").df,
    )
    each = orders.withColumn("rows", F.lit("each"))
    grouped = augment.group_base(orders, "c_name", ["y", "acctbal"], "y").withColumn("rows", F.lit("grouped"))
    # Both sets of rows are split by customer, so no customer is on both sides.
    both = split.hash_split(each.unionByName(grouped), F.col("c_name"), seed=7)
    rows = augment.augment_hits(both, "c_name", lake.tables(), best_hits(lake, 6), 6)
    rows = materialize(rows, "grid-rows")
    lists = gram.added_lists(["acctbal"], [f"hit_{p}" for p in range(1, 7)])
    metrics = gram.train_eval_lists(rows, "y", lists, ["rows"])
    return rounded(metrics, "rmse", "mse", "mae", "r2", "pearson", "median_ae")


@register
def perm_importance_lines(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _line_model(Lake(spark, folder))
    found = models.permutation_importance(
        model, test, F.col("c_custkey"), "y", LINE_FEATURES
    )
    return rounded(found, "importance", "stddev", "p_value", "p99_high", "p99_low")


@register
def ice_curves_lines(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _line_model(Lake(spark, folder))
    curves = models.ice_curves(
        model, test, F.col("c_custkey"), "n_items", quantiles=5, centered=True
    )
    return rounded(curves, "prediction")


@register
def pdp_curve_lines(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _line_model(Lake(spark, folder))
    curves = models.ice_curves(
        model, test, F.col("c_custkey"), "n_items", quantiles=5
    )
    return rounded(models.pdp_curve(curves), "prediction")
