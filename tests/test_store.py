import os

import pytest
from pyspark.sql import functions as F

from lakekin import PAIR, SketchOptions
from lakekin.operators import search, sketch
from lakekin.operators.index_store import TermStore, append_terms
from lakekin.operators.pairs import cell_pair_means, lake_means, LakeTable, query_means
from lakekin.operators.sketch import index_stats, inverted_lists, pair_sketch, term_index
from lakekin.plans import queries
from lakekin.sources.files import csv_cells
from lakekin.streaming.index_stream import index_stream, stream_files


@pytest.fixture(scope="module")
def lake(spark):
    def table(name, shift):
        df = spark.range(300).select(
            F.concat(F.lit("k"), F.col("id") + shift).alias("k"),
            F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"),
        )
        return LakeTable(name, df, ("k",), ("v",))

    return [table("t0", 0), table("t1", 50), table("t2", 100)]


def rows(terms):
    return sorted(tuple(r) for r in terms.select("term", *PAIR).collect())


def test_append_is_idempotent(spark, lake, tmp_path):
    want = rows(term_index(lake_means(lake)))
    store = TermStore(spark, str(tmp_path / "index"))
    assert store.terms().count() == 0
    store.append(lake_means(lake[:2]), "one")
    store.append(lake_means(lake), "two")
    store.append(lake_means(lake), "two")
    store.append(lake_means(lake), "three")
    assert rows(store.terms()) == want
    half = term_index(lake_means(lake[:2]))
    assert rows(append_terms(half, term_index(lake_means(lake)))) == want


def test_unfinished_batch_is_ignored_and_repaired(spark, lake, tmp_path):
    path = str(tmp_path / "index")
    store = TermStore(spark, path)
    store.append(lake_means(lake[:1]), "one")
    # An attempt that died after its terms and before its list of tables.
    term_index(lake_means(lake[1:2])).write.parquet(f"{path}/terms/attempt=dead")
    assert rows(store.terms()) == rows(term_index(lake_means(lake[:1])))
    store.append(lake_means(lake[1:2]), "two")
    assert rows(store.terms()) == rows(term_index(lake_means(lake[:2])))


def test_rewrite_compact_and_vacuum(spark, lake, tmp_path):
    path = tmp_path / "index"
    store = TermStore(spark, str(path))
    store.append(lake_means(lake[:1]), "one")
    store.append(lake_means(lake[1:2]), "two")
    before = rows(store.terms())
    opened = store.terms()
    # A second attempt at a committed batch leaves the first one readable.
    store.append(lake_means(lake[1:2]), "two")
    assert rows(opened) == rows(store.terms()) == before
    store.compact()
    assert rows(store.terms()) == before and len(store.attempts()) == 1
    assert {r["table_id"] for r in store.tables().collect()} == {"t0", "t1"}
    assert len(store.vacuum()) == 6 and store.vacuum() == []
    assert rows(store.terms()) == before
    assert len(list((path / "terms").glob("attempt=*"))) == 1


def test_query_of_any_number_of_pairs(spark, lake, tmp_path, monkeypatch):
    store = TermStore(spark, str(tmp_path / "index"))
    store.append(lake_means(lake), "one")
    query = lake_means(lake)
    want = search.search_signed(store.terms(), query, 10).collect()
    assert want[0]["count"] >= 128
    assert search.search_signed(store.for_query(query), query, 10).collect() == want
    monkeypatch.setattr(search, "MAX_LITERALS", 5)
    joined = store.for_query(query)
    assert "In(term" not in joined._jdf.queryExecution().executedPlan().toString()
    assert search.search_signed(joined, query, 10).collect() == want


def test_replace_and_options(spark, lake, tmp_path):
    path = str(tmp_path / "index")
    store = TermStore(spark, path)
    store.append(lake_means(lake), "one")
    store.replace(lake_means(lake[2:]))
    assert rows(store.terms()) == rows(term_index(lake_means(lake[2:])))
    store.append(lake_means(lake[:1]), "next")
    assert {r["table_id"] for r in store.tables().collect()} == {"t2", "t0"}
    TermStore(spark, path, SketchOptions(size=32))  # another sample size is compatible
    with pytest.raises(ValueError):
        TermStore(spark, path, SketchOptions(hash_order="le_signed"))
    with pytest.raises(ValueError):
        TermStore(spark, path, SketchOptions(label="sql"))


def test_stored_search_reads_only_the_query_terms(spark, lake, tmp_path):
    store = TermStore(spark, str(tmp_path / "index"))
    store.append(lake_means(lake), "one")
    query = query_means(lake[0].df, "k", "v")
    opts = SketchOptions()
    pruned = store.for_query(query)
    assert "In(term" in pruned._jdf.queryExecution().executedPlan().toString()
    full = search.search_signed(store.terms(), query, 10, opts).collect()
    assert search.search_signed(pruned, query, 10, opts).collect() == full
    assert (full[0]["table_id"], full[0]["count"]) == ("t0", 128)
    other = search.search_absolute(store.terms(), query, 10, opts, query_size=32).collect()
    small = store.for_query(query, query_size=32)
    assert search.search_absolute(small, query, 10, opts, query_size=32).collect() == other
    counted = search.search_counter(store.for_query(query, query_size=100), query, opts).collect()
    assert counted == search.search_counter(store.terms(), query, opts).collect()


def test_index_summaries(lake):
    terms = term_index(lake_means(lake))
    stats = index_stats(terms).collect()
    assert {r["n_terms"] for r in stats} == {128}
    # The sample holds the small key hashes; term hashes are uniform again.
    assert all(abs(r["mean_prefix"] / 16**7 - 0.5) < 0.15 for r in stats)
    lists = inverted_lists(terms).collect()
    assert sum(len(r["pairs"]) for r in lists) == 3 * 128


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()

    def put(name, n):
        (folder / f"{name}.csv").write_text("k;v\n" + "".join(f"key{i};{(i * 37) % 101}\n" for i in range(n)))

    store = TermStore(spark, str(tmp_path / "index"))

    def run():
        files = stream_files(spark, str(folder), per_batch=1)
        index_stream(files, store, str(tmp_path / "state")).awaitTermination()

    put("a", 40)
    put("b", 60)
    run()
    put("c", 30)
    run()
    run()
    batch = csv_cells(spark.read.format("binaryFile").load(str(folder))).cells
    assert rows(store.terms()) == rows(term_index(cell_pair_means(batch)))
    assert store.tables().count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
@pytest.mark.parametrize(
    "name",
    ["inverted_lists", "pair_sketch", "pair_sketch_le_signed", "search_multi_stored", "search_stored", "term_index", "term_index_hex", "term_index_inner"],
)
def test_index_sorts_no_key_that_no_sketch_holds(spark, monkeypatch, name):
    sorted_rows = []

    def counted(means, *opts):
        if not sorted_rows:  # the index; the query of a search comes after it
            sorted_rows.append(means.groupBy(*PAIR).count().agg({"count": "max"}).first()[0])
        return pair_sketch(means, *opts)

    monkeypatch.setattr(sketch, "pair_sketch", counted)
    queries.REGISTRY[name](spark, "/root/testdata/sf0.01")
    # The sketch and the rest of its last bin; the largest pair has 2000 keys.
    assert sorted_rows[0] < 128 + 16
