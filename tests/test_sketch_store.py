"""Sketches that merge: an index of parts equals the index of the whole."""

import pytest
from pyspark.sql import functions as F

from lakekin.operators.index_store import TermStore
from lakekin.operators.sketch_store import SketchStore
from lakekin.options import SketchOptions
from lakekin.session import new_folder

CELLS = "table_id string, row_id long, column_id int, column_name string, cell string, num double"
SMALL = SketchOptions(size=16, rel_eps=1e-9)


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for t, n in (("big", 400), ("odd", 60), ("tiny", 9)):
        for r in range(n):
            rows.append((t, r, 0, "key", f"k{r * 7 % 90}", None))
            # Text in all rows but one late one.
            late = t == "odd" and r == 59
            rows.append((t, r, 1, "mixed", "5" if late else f"m{r % 5}", 5.0 if late else None))
            number = None if r % 11 == 0 else float(r * r % 37)
            rows.append((t, r, 2, "value", None if number is None else str(number), number))
    frame = spark.createDataFrame(rows, CELLS)
    path = new_folder(spark, "cells")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def listed(df):
    return sorted(map(tuple, df.collect()))


def whole(spark, cells):
    store = TermStore(spark, new_folder(spark, "whole"), SMALL)
    store.append_cells(cells, "all", min_rows=12)
    return listed(store.terms())


def merged(spark):
    return SketchStore(spark, new_folder(spark, "parts"), SMALL, min_rows=12)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_parts_equal_the_whole(spark, cells, parts):
    store = merged(spark)
    for part in range(parts):
        store.append_cells(cells.where(F.col("row_id") % parts == part), f"b{part}")
    assert listed(store.terms()) == whole(spark, cells)
    assert {r.table_id for r in store.tables().collect()} == {"big", "odd", "tiny"}


def test_a_repeated_batch_counts_once(spark, cells):
    store = merged(spark)
    for part in (0, 1, 0, 1, 1):
        store.append_cells(cells.where(F.col("row_id") % 2 == part), f"b{part}")
    sums = {(r.table_id, r.value_col, r.key): r.n for r in store.merged_sums().where("key_col = 'key'").collect()}
    direct = cells.where("column_id = 0").alias("k").join(cells.where("column_id = 2").alias("v"), ["table_id", "row_id"])
    expected = direct.groupBy("table_id", F.col("k.cell").alias("key")).agg(F.count("v.num").alias("n"))
    counts = {(r.table_id, "value", r.key): r.n for r in expected.collect()}
    # Only sketched keys are stored; those of the final sketch are complete.
    final = store.sketches().where("key_col = 'key'").collect()
    assert final and all(sums[r.table_id, r.value_col, r.key] == counts[r.table_id, r.value_col, r.key] for r in final)
    assert listed(store.terms()) == whole(spark, cells)


def test_roles_are_those_of_the_whole(spark, cells):
    """A column that turns out mixed leaves the index; a table enters when it is large enough."""
    store = merged(spark)
    store.append_cells(cells.where("row_id < 10"), "early")
    assert {r.table_id for r in store.terms().select("table_id").collect()} == set()
    store.append_cells(cells.where("row_id between 10 and 50"), "middle")
    columns = {(r.table_id, r.key_col) for r in store.terms().collect()}
    assert columns == {("big", "key"), ("big", "mixed"), ("odd", "key"), ("odd", "mixed")}
    store.append_cells(cells.where("row_id > 50"), "late")
    assert ("odd", "mixed") not in {(r.table_id, r.key_col) for r in store.terms().collect()}
    assert listed(store.terms()) == whole(spark, cells)


def test_compaction_keeps_growing(spark, cells):
    store = merged(spark)
    for part in range(2):
        store.append_cells(cells.where(F.col("row_id") % 3 == part), f"b{part}")
    store.compact()
    removed = store.vacuum()
    assert len(removed) == 4
    store.append_cells(cells.where("row_id % 3 = 2"), "rest")
    assert listed(store.terms()) == whole(spark, cells)


def test_rows_of_declared_roles(spark):
    rows = spark.createDataFrame([("t", "k", "v", f"x{i % 30}", float(i)) for i in range(100)], "table_id string, key_col string, value_col string, key string, value double")
    parts, once = (SketchStore(spark, new_folder(spark, "rows"), SMALL) for _ in range(2))
    parts.append_rows(rows.where("value < 40"), "a")
    parts.append_rows(rows.where("value >= 40"), "b")
    once.append_rows(rows, "a")
    assert listed(parts.terms()) == listed(once.terms()) != []


def test_means_do_not_merge(spark):
    store = merged(spark)
    for refused in (store.append, store.append_tables):
        with pytest.raises(TypeError):
            refused(None, "a")
    assert store.terms().collect() == []
