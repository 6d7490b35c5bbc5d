"""Tables that are indexed when they are complete."""

import time

import pytest
from pyspark.sql import functions as F

from lakekin.operators.sketch_store import SketchStore
from lakekin.options import PAIR, SketchOptions
from lakekin.session import new_folder
from lakekin.operators import pairs
from lakekin.streaming.table_stream import ARRIVING_SCHEMA, index_tables

SMALL = SketchOptions(size=16)


def rows_of(table, start, end):
    return [(table, "k", v, f"{r * 7 % 90}", float(r * r % 37), False) for r in range(start, end) for v in ("a", "b")]


@pytest.fixture
def arrivals(spark):
    folder = new_folder(spark, "arriving")
    store = SketchStore(spark, new_folder(spark, "store"), SMALL)
    state = new_folder(spark, "state")

    def arrive(rows, **options):
        spark.createDataFrame(rows, ARRIVING_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ARRIVING_SCHEMA).parquet(folder)
        index_tables(stream, store, state, salts=2, **options).awaitTermination()
        return sorted(map(tuple, store.terms().collect()))

    return arrive


def expected(spark, rows):
    store = SketchStore(spark, new_folder(spark, "whole"), SMALL)
    store.append_rows(spark.createDataFrame(rows, ARRIVING_SCHEMA).select(*PAIR, "key", "value"), "all")
    return sorted(map(tuple, store.terms().collect()))


def test_ends_late_rows_and_empty_values(spark, arrivals):
    one, other = rows_of("t", 0, 300), rows_of("u", 0, 40)
    end = [("t", None, None, None, None, True)]
    odd = [("t", "k", "a", None, 1.0, False), ("t", "k", "a", "x", None, False)]
    assert arrivals(one[:250] + other + odd) == []
    assert arrivals(one[250:400] + end) == expected(spark, one[:400])
    # Late rows, and a second end of the same table.
    assert arrivals(one[400:] + end) == expected(spark, one)
    assert arrivals([("u", None, None, None, None, True), ("new", None, None, None, None, True)]) == expected(spark, one + other)


def test_a_silent_table_closes(spark, arrivals):
    rows = rows_of("t", 0, 50)
    assert arrivals(rows, idle_seconds=1) == []
    time.sleep(1.5)
    assert arrivals(rows_of("u", 0, 5), idle_seconds=1) == expected(spark, rows)


def test_arriving_rows_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No third of the rows of a lake goes through one task."""
    from lakekin.plans import queries

    cells = spark.range(0, 4000, 1, 4).selectExpr(
        "'t' AS table_id", "id DIV 2 AS row_id", "CAST(id % 2 AS INT) AS column_id",
        "IF(id % 2 = 0, 'k', 'v') AS column_name", "IF(id % 2 = 0, concat('key', id), CAST(id AS STRING)) AS cell",
        "IF(id % 2 = 1, CAST(id AS DOUBLE), NULL) AS num",
    )
    folders = {}

    def folder(session, name):
        return folders.setdefault(name, str(tmp_path / name))

    monkeypatch.setattr(queries, "written_cells", lambda lake: cells)
    monkeypatch.setattr(queries, "new_folder", folder)
    rows = pairs.cell_pair_rows(cells, min_rows=12, block_rows=100)
    monkeypatch.setattr(queries.pairs, "cell_pair_rows", lambda *_, **__: rows.repartition(4, "key"))
    assert queries.index_table_stream(spark, "").count() == 128
    assert len(spark.read.parquet(folders["arriving"]).inputFiles()) > 4
