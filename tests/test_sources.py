import gzip
import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakekin.operators.mapper import map_blocks, map_tables
from lakekin.operators.pairs import cell_pair_means, wide_pair_means
from lakekin.operators.profile import column_pairs, column_profile, large_tables, table_stats
from lakekin.sources import cells as tall
from lakekin.sources import files


def as_rows(cells):
    return sorted(
        (r["table_id"], r["row_id"], r["column_id"], r["column_name"], r["cell"], r["num"])
        for r in cells.collect()
    )


@pytest.fixture(scope="module")
def csv_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    (folder / "a__b.csv").write_text('﻿name;n;m\nx;1;\n"y;z";2;5.5\n"q""t";nan;7\n', encoding="utf-8")
    (folder / "other.csv").write_text("k;v\n" + "".join(f"key{i};{i}\n" for i in range(50)))
    (folder / "bad.csv").write_text("a;b\n1;2\n1;2;3;4\n")
    (folder / "notes.txt").write_text("k;v\n1;2\n")
    return folder


def test_csv_folder(spark, csv_folder):
    source = files.read_csv_lake(spark, str(csv_folder))
    rows = [r for r in as_rows(source.cells.where("table_id = 'a__b'"))]
    assert rows == [
        ("a__b", 0, 0, "name", "x", None), ("a__b", 0, 1, "n", "1", 1.0), ("a__b", 0, 2, "m", None, None),
        ("a__b", 1, 0, "name", "y;z", None), ("a__b", 1, 1, "n", "2", 2.0), ("a__b", 1, 2, "m", "5.5", 5.5),
        ("a__b", 2, 0, "name", 'q"t', None), ("a__b", 2, 1, "n", None, None), ("a__b", 2, 2, "m", "7", 7.0),
    ]
    assert source.cells.where("table_id = 'other'").count() == 100
    assert source.cells.where("table_id = 'notes'").count() == 0
    assert [r["table_id"] for r in source.errors.collect()] == ["bad"]


def test_large_csv_files_are_read_as_lines(spark, csv_folder):
    whole = files.read_csv_lake(spark, str(csv_folder)).cells.where("table_id <> 'bad'")
    lines = files.read_csv_lines(spark, str(csv_folder))
    assert as_rows(lines.cells) == as_rows(whole)
    assert [r["table_id"] for r in lines.errors.collect()] == ["bad"]


def test_equal_stems_and_headers_and_late_errors(spark, tmp_path):
    for name, text in {
        "a/x.csv": "k;v\nr;10\n",
        "b/x.csv": "k;v\nr;1\n",
        "twice.csv": "k;v;v\na;1;100\n",
        "late.csv": "k;v\n" + "p;1\n" * 25_000 + "p;1;2;3\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    whole, lines = files.read_csv_lake(spark, str(tmp_path)), files.read_csv_lines(spark, str(tmp_path))
    assert {r["table_id"] for r in whole.cells.select("table_id").distinct().collect()} == {"a/x", "b/x", "twice"}
    assert as_rows(whole.cells) == as_rows(lines.cells)
    assert [r["column_name"] for r in whole.cells.where("table_id = 'twice'").orderBy("column_id").collect()] == ["k", "v", "v.1"]
    for source in (whole, lines):
        assert [r["table_id"] for r in source.errors.collect()] == ["late"]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "dwtc-007.json").write_text("".join(json.dumps({"relation": [[f"h{i}", "x"], ["1", "2"], ["3", "4"]]}) + "\n" for i in range(40)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    ids = []
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = files.read_web_tables(spark, str(tmp_path), "*.json").cells.select("table_id").distinct().collect()
        ids.append(sorted(r["table_id"] for r in found))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids[0] == ids[1] == sorted(f"dwtc-007_{i}" for i in range(40))


def test_split_lines_keep_unique_ordered_row_ids(spark, tmp_path):
    (tmp_path / "big.csv").write_text("k;v\n" + "".join(f"key{i:05d};{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        cells = files.read_csv_lines(spark, str(tmp_path)).cells
        keys = [r["cell"] for r in cells.where("column_name = 'k'").orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert keys == [f"key{i:05d}" for i in range(20_000)]


def test_fields_over_lines_are_reported_not_broken(spark, tmp_path):
    (tmp_path / "multi.csv").write_text('k;v\n"a\nb";1\n')
    whole = files.read_csv_lake(spark, str(tmp_path))
    assert [r["cell"] for r in whole.cells.where("column_id = 0").collect()] == ["a\nb"]
    lines = files.read_csv_lines(spark, str(tmp_path))
    assert {r["table_id"] for r in lines.errors.collect()} == {"multi"}


def test_archives(spark, tmp_path):
    def entry(table):
        out = io.BytesIO()
        pq.write_table(table, out)
        return out.getvalue()

    with zipfile.ZipFile(tmp_path / "x'y.zip", "w") as z:
        z.writestr("dir/good.parquet", entry(pa.table({"k": ["a", None], "v": [1, None], "f": [0.5, 2.0], "l": [[1, 2], None]})))
        z.writestr("broken.parquet", b"no parquet")
        z.writestr("skip.csv", b"a;b")
    (tmp_path / "junk.zip").write_bytes(b"not a zip")
    source = files.read_archives(spark, str(tmp_path))
    assert as_rows(source.cells) == [
        ("xy_dir/good", 0, 0, "k", "a", None), ("xy_dir/good", 0, 1, "v", "1", 1.0),
        ("xy_dir/good", 0, 2, "f", "0.5", 0.5), ("xy_dir/good", 0, 3, "l", "[1 2]", None),
        ("xy_dir/good", 1, 0, "k", None, None), ("xy_dir/good", 1, 1, "v", None, None),
        ("xy_dir/good", 1, 2, "f", "2.0", 2.0), ("xy_dir/good", 1, 3, "l", None, None),
    ]
    assert {r["table_id"] for r in source.errors.collect()} == {"junk", "xy_broken"}


def test_web_tables(spark, tmp_path):
    lines = [
        [["id", "a", "b"], ["n", "1", "2"]],          # wider than high: transposed, header
        [["x", "y"], ["1", "2"], ["3", "4"]],         # upright, header
        [["x", "x"], ["1", "2"], ["3", "4"]],         # repeated header: positions
        [["1", "y"], ["5", "2"], ["3", "4"]],         # a number in the first row
        [["h", None], ["5", "2"], ["3"]],             # missing header cell, ragged row
    ]
    text = "\n".join(json.dumps({"relation": r, "url": "u"}) for r in lines) + "\n{broken\n"
    with gzip.open(tmp_path / "dwtc-004.json.gz", "wt") as out:
        out.write(text)
    source = files.read_web_tables(spark, str(tmp_path))
    got = {}
    for table, row, column, name, cell, num in as_rows(source.cells):
        got.setdefault(table, []).append((row, column, name, cell, num))
    assert got["dwtc-004_0"] == [
        (0, 0, "id", "a", None), (0, 1, "n", "1", 1.0), (1, 0, "id", "b", None), (1, 1, "n", "2", 2.0),
    ]
    assert [c[2] for c in got["dwtc-004_1"]] == ["x", "y", "x", "y"] and len(got["dwtc-004_1"]) == 4
    assert [c[2] for c in got["dwtc-004_2"]] == ["0", "1"] * 3
    assert got["dwtc-004_3"][0] == (0, 0, "0", "1", 1.0)
    assert len(got["dwtc-004_3"]) == 6
    assert got["dwtc-004_4"][-1] == (2, 1, "1", None, None) and len(got["dwtc-004_4"]) == 6
    assert {r["table_id"] for r in source.errors.collect()} == {"dwtc-004_5"}


def test_query_loading_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "k string, i int, v double")
    assert [tuple(r) for r in files.load_query(df, 0, 2).collect()] == [("a", 2.0)]
    assert files.load_query(df, "k", "i").count() == 2
    out = str(tmp_path / "out")
    files.export_csv(df.coalesce(1), out)
    back = files.read_query(spark, out, "k", "i")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.0), ("b", 2.0)]


def mixed_cells(spark):
    wide = spark.createDataFrame(
        [(i, f"k{i % 4}", None if i == 3 else f"t{i}", "7" if i % 2 else "x", float(i), None if i == 5 else i)
         for i in range(12)],
        "id long, full string, holes string, mixed string, num double, gaps int",
    )
    short = wide.where("id < 11")
    columns = ["full", "holes", "mixed", "num", "gaps"]
    return tall.union_cells(
        tall.cells_from_wide(df, name, F.col("id"), columns) for df, name in ((wide, "long"), (short, "a__short"))
    ), wide, columns


def test_roles_and_gate(spark):
    cells, _, _ = mixed_cells(spark)

    def roles(**rules):
        rows = column_profile(cells, **rules).where("table_id = 'long'").collect()
        return {r["column_name"]: r["role"] for r in rows}

    assert roles() == {"full": "key", "holes": None, "mixed": None, "num": "measure", "gaps": "measure"}
    assert roles(null_as_nan=False) == {"full": "key", "holes": "key", "mixed": None, "num": "measure", "gaps": None}
    assert roles(rule="dtype") == {"full": "key", "holes": "key", "mixed": "key", "num": "measure", "gaps": "measure"}
    with pytest.raises(ValueError):
        roles(rule="guess")
    pairs = column_pairs(cells, min_rows=12).collect()
    assert {(r["table_id"], r["key_col"], r["value_col"]) for r in pairs} == {
        ("long", "full", "num"), ("long", "full", "gaps"),
    }
    assert [r["table_id"] for r in large_tables(cells, 12).collect()] == ["long"]
    stats = {r["table_id"]: (r["n_rows"], r["n_columns"]) for r in table_stats(cells).collect()}
    assert stats == {"long": (12, 5), "a__short": (11, 5)}


@pytest.mark.parametrize("block_rows", [1 << 16, 3])
def test_tall_and_wide_give_the_same_means(spark, block_rows):
    cells, wide, _ = mixed_cells(spark)
    tall_means = cell_pair_means(cells, rule="dtype", block_rows=block_rows).where("table_id = 'long'")
    wide_means = wide_pair_means(wide, "long", ["full", "holes", "mixed"], ["num", "gaps"])
    assert sorted(tall_means.collect()) == sorted(wide_means.collect())
    by_position = cell_pair_means(cells, label_by="position").where("table_id = 'long'")
    assert {(r["key_col"], r["value_col"]) for r in by_position.collect()} == {("0", "3"), ("0", "4")}


def test_row_assembly_and_role_join_share_one_exchange(spark):
    cells, _, _ = mixed_cells(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cell_pair_means(cells)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    row_exchanges = [l for l in plan.splitlines() if "Exchange" in l and "row_id" in l]
    assert row_exchanges == []  # rows are grouped on the (table, block) exchange
    assert "SortAggregate" not in plan


def test_store_clean_and_rebuild(spark, tmp_path):
    cells, wide, columns = mixed_cells(spark)
    tall.save_cells(cells, str(tmp_path / "cells"))
    loaded = tall.load_cells(spark, str(tmp_path / "cells"))
    assert as_rows(loaded) == as_rows(cells)
    rebuilt = tall.rebuild_table(loaded, "long", 5).orderBy("row_id").collect()
    want = wide.select("id", *[F.col(c).cast("string") for c in columns]).orderBy("id").collect()
    assert [tuple(r) for r in rebuilt] == [tuple(r) for r in want]
    odd = tall.cells_from_wide(spark.createDataFrame([(" Bear ", " 5 ")], "a string, b string"), "t")
    assert [r["cell"] for r in tall.clean_cells(odd).orderBy("column_id").collect()] == ["bear", " 5 "]


def test_map_tables(spark):
    import pandas as pd

    cells, _, _ = mixed_cells(spark)

    def summary(table):
        if table.columns.name == "a__short":
            raise RuntimeError("no")
        return pd.DataFrame({"rows": [len(table)], "total": [table["num"].sum()]})

    schema = "rows bigint, total double"
    results, errors = map_tables(cells, summary, schema)
    assert [tuple(r) for r in results.collect()] == [("long", 12, 66.0)]
    assert [tuple(r) for r in errors.collect()] == [("a__short", "RuntimeError: no")]
    combine = [F.sum("rows").alias("rows"), F.sum("total").alias("total")]
    merged, failed = map_blocks(cells, summary, schema, combine, block_rows=4)
    assert [tuple(r) for r in merged.collect()] == [("long", 12, 66.0)]
    assert [r["table_id"] for r in failed.collect()] == ["a__short"]


def test_equal_headers_stay_apart(spark):
    rows = [("t", r, c, n, str(v)) for r in range(4) for c, n, v in [(0, "k", f"key{r}"), (1, "v", r), (2, "v", 10 * r)]]
    cells = spark.createDataFrame(rows, "table_id string, row_id long, column_id int, column_name string, cell string")
    cells = cells.withColumn("num", F.expr("try_cast(cell as double)"))
    found = {(r["value_col"], r["key"]): r["value"] for r in cell_pair_means(cells).collect()}
    assert found == {(n, f"key{r}"): float(r * f) for r in range(4) for n, f in (("v", 1), ("v#2", 10))}
    import pandas as pd

    wide, _ = map_tables(cells, lambda t: pd.DataFrame({"n": [t.shape[1]]}), "n bigint")
    assert wide.first()["n"] == 3


@pytest.mark.parametrize(
    "text, number",
    [(" 5\t", 5.0), ("-1.5e3", -1500.0), ("5.", 5.0), (".5", 0.5), ("+.5E-1", 0.05), ("-inf", float("-inf")), (" Infinity ", float("inf")),
     ("1-URGENT", None), ("e5", None), (".", None), ("5 5", None), ("", None), ("5e", None), ("\tinf", None), ("1_0", None)],
)
def test_numbers_are_told_by_their_form(spark, text, number):
    from lakekin.functions.numeric import NUMBER_TEXT, parse_number

    row = spark.createDataFrame([(text,)], "c string").select(
        parse_number(F.col("c")).alias("v"), F.col("c").rlike(NUMBER_TEXT).alias("form")
    ).first()
    assert row["v"] == number
    # Text never reaches the cast, whose exceptions are what the time went into.
    assert row["form"] or number is None
    assert not (row["form"] and text in ("1-URGENT", "e5", ".", "5 5", "", "5e", "1_0"))


def test_rows_are_put_together_without_merging_lists(spark):
    cells, _, _ = mixed_cells(spark)
    plan = cell_pair_means(cells)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "lambda" not in plan


def test_blocks_run_the_function_once(spark):
    import pandas as pd

    cells, _, _ = mixed_cells(spark)
    merged, _ = map_blocks(cells, lambda t: pd.DataFrame({"n": [len(t)]}), "n bigint", [F.sum("n").alias("n")], block_rows=4)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    assert sorted(tuple(r) for r in merged.collect()) == [("a__short", 11), ("long", 12)]
