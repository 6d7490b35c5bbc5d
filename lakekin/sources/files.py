"""Lakes kept as files: folders of CSV tables, zip archives of Parquet, web-table lines.

Decoding is the only Python work. It streams: a decoder holds one block of
rows of one file at a time. A file is read through once before any of it is given
out, so a table with an error anywhere gives an error and no cells.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekin.functions.numeric import parse_number
from lakekin.sources.cells import (
    CELL_COLUMNS,
    RAW_SCHEMA,
    CellSource,
    split_errors,
)

# Fixed value: the most that Spark holds as one binary value.
BINARY_LIMIT = (1 << 31) - 1024
BLOCK_ROWS = 20_000
# Fixed value: name pattern of web tables, by chunk and line.
WEB_TABLE_ID = "dwtc-%03d_%d"

# Field texts a CSV reader takes as missing.
MISSING = frozenset(
    ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
     "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
)

FILE_COLUMNS = ["path", "content"]


def _stem(path: str) -> str:
    return PurePosixPath(path).stem


def table_name(path: str, root: str | None) -> str:
    """A table's id: its path below ``root`` without the ending; without root the stem.

    Files of one name in different folders are different tables.
    """
    plain = lambda p: unquote(re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", p)).rstrip("/")
    if root is None or not plain(path).startswith(plain(root) + "/"):
        return _stem(path)
    below = PurePosixPath(plain(path)[len(plain(root)) + 1 :])
    return str(below.with_suffix(""))


def _missing(value: object) -> bool:
    """Missing, for one cell of any type; a list is a value."""
    return value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value)


def _error(table_id: str, problem: object) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "table_id": [table_id],
            "row_id": [None],
            "column_id": [None],
            "column_name": [None],
            "cell": [None],
            "error": [f"{type(problem).__name__}: {problem}"],
        }
    )


def _block_cells(table_id: str, first_row: int, names: list[str], block: pd.DataFrame) -> pd.DataFrame:
    """Cells of a block of rows in row order; missing values stay missing."""
    rows, columns = block.shape
    values = block.to_numpy(dtype=object).ravel()
    return pd.DataFrame(
        {
            "table_id": table_id,
            "row_id": pd.RangeIndex(first_row, first_row + rows).repeat(columns),
            "column_id": list(range(columns)) * rows,
            "column_name": names * rows,
            "cell": [None if _missing(v) else str(v) for v in values],
            "error": None,
        }
    )


def _csv_blocks(content: bytes, separator: str) -> Iterator[tuple[int, pd.DataFrame]]:
    reader = pd.read_csv(
        io.BytesIO(content),
        sep=separator,
        dtype=str,
        encoding="utf-8-sig",
        chunksize=BLOCK_ROWS,
    )
    done = 0
    for block in reader:
        yield done, block
        done += len(block)


def csv_cells(files: DataFrame, separator: str = ";", root: str | None = None) -> CellSource:
    """Cells of whole CSV files given as ``(path, content)``; ids are :func:`table_name`."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                table_id = table_name(path, root)
                try:
                    for _ in _csv_blocks(content, separator):
                        pass
                    for first, block in _csv_blocks(content, separator):
                        yield _block_cells(table_id, first, list(block.columns), block)
                except Exception as problem:
                    yield _error(table_id, problem)

    return split_errors(files.select(*FILE_COLUMNS).mapInPandas(decode, RAW_SCHEMA))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Add ``line``, the number of the line in its file, to ``(value, path, start)``.

    ``start`` is the byte where the file split begins. Lines are counted per
    split first; the counts of the splits before give each split its offset, so
    numbers do not depend on how files are split.
    """
    placed = lines.select("path", "start", "value", F.monotonically_increasing_id().alias("id"))
    splits = placed.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(splits, ["path", "start"])
    return numbered.select("path", (F.col("id") - F.col("first") + F.col("offset")).alias("line"), "value")


def _text_lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _distinct_names(names: list[str | None]) -> list[str]:
    """Headers as a CSV reader names them: repeated ones numbered, empty ones by place."""
    out: list[str] = []
    for i, name in enumerate(names):
        own = name if name else f"Unnamed: {i}"
        free, n = own, 0
        while free in out:
            n += 1
            free = f"{own}.{n}"
        out.append(free)
    return out


def csv_line_cells(lines: DataFrame, separator: str = ";", root: str | None = None) -> CellSource:
    """Cells of CSV files given as numbered lines ``(path, line, value)``.

    For files that no task can hold: lines of one file are decoded by many tasks.
    A table with a field that spans lines, or with a row longer than its header,
    is an error and has no cells.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, block in batch.groupby("path", sort=False):
                table_id = table_name(path, root)
                broken = block["value"].str.count('"') % 2 == 1
                if broken.any():
                    yield _error(table_id, ValueError("a quoted field spans lines"))
                block = block[~broken & (block["value"] != "")]
                rows = list(csv.reader(block["value"], delimiter=separator))
                if not rows:
                    continue
                columns = [list(range(len(r))) for r in rows]
                yield pd.DataFrame(
                    {
                        "table_id": table_id,
                        "row_id": [n for n, r in zip(block["line"], rows) for _ in r],
                        "column_id": [c for r in columns for c in r],
                        "column_name": None,
                        "cell": [v if v not in MISSING else None for r in rows for v in r],
                        "error": None,
                    }
                )

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, value in zip(batch["path"], batch["value"]):
                names = _distinct_names(next(csv.reader([value.removeprefix("\ufeff")], delimiter=separator), []))
                yield pd.DataFrame({"table_id": table_name(path, root), "column_id": range(len(names)), "column_name": names})

    header = lines.where(F.col("line") == 0).mapInPandas(head, "table_id string, column_id int, column_name string")
    raw = lines.where(F.col("line") > 0).mapInPandas(decode, RAW_SCHEMA).drop("column_name")
    named = raw.join(header, ["table_id", "column_id"], "left")
    long = F.col("error").isNull() & F.col("column_name").isNull()
    named = named.withColumn("error", F.when(long, "ValueError: a row is longer than the header").otherwise(F.col("error")))
    source = split_errors(named.withColumn("row_id", F.col("row_id") - 1))
    errors = source.errors.groupBy("table_id").agg(F.min("error").alias("error"))
    return CellSource(source.cells.join(errors.select("table_id"), "table_id", "left_anti"), errors)


def read_csv_lake(spark: SparkSession, path: str, separator: str = ";") -> CellSource:
    """All ``*.csv`` tables below ``path``, each decoded whole by one task.

    A file that is no single Spark value (2 GB) is an error that names
    :func:`read_csv_lines`, which decodes lines of a file by many tasks.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    found = csv_cells(files.where(F.col("length") <= BINARY_LIMIT), separator, path)
    large = files.where(F.col("length") > BINARY_LIMIT).select(
        F.col("path").alias("table_id"), F.lit("too large for one value: use read_csv_lines").alias("error")
    )
    return CellSource(found.cells, found.errors.unionByName(large))


def read_csv_lines(spark: SparkSession, path: str, separator: str = ";") -> CellSource:
    """CSV files of any size, read as lines; see :func:`csv_line_cells`."""
    return csv_line_cells(numbered_lines(_text_lines(spark, path, "*.csv")), separator, path)


def archive_cells(files: DataFrame, root: str | None = None) -> CellSource:
    """Cells of zip archives of Parquet tables given as ``(path, content)``.

    The table id is the archive's :func:`table_name` (without quotes) and the
    entry's path in it without the ending.
    Entries that are not Parquet are left out; unreadable ones are errors.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                chunk = table_name(path, root).replace("'", "")
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except Exception as problem:
                    yield _error(chunk, problem)
                    continue
                for entry in archive.namelist():
                    if not entry.endswith(".parquet"):
                        continue
                    table_id = f"{chunk}_{PurePosixPath(entry).with_suffix('')}"
                    try:
                        table = pq.ParquetFile(io.BytesIO(archive.read(entry)))
                        for _ in table.iter_batches(BLOCK_ROWS):
                            pass
                        done = 0
                        for block in table.iter_batches(BLOCK_ROWS):
                            frame = block.to_pandas(integer_object_nulls=True)
                            names = [str(c) for c in frame.columns]
                            yield _block_cells(table_id, done, names, frame)
                            done += len(frame)
                    except Exception as problem:
                        yield _error(table_id, problem)

    return split_errors(files.select(*FILE_COLUMNS).mapInPandas(decode, RAW_SCHEMA))


def read_archives(spark: SparkSession, path: str) -> CellSource:
    """All zip archives below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return archive_cells(files, path)


def relation_cells(relations: DataFrame) -> DataFrame:
    """Cells of web tables ``(table_id, relation array<array<string>>)``.

    A relation wider than high is transposed; its first row is the header when
    all of it is distinct text, otherwise columns are named by position. All
    of it is built-in array work on one record.
    """
    sized = relations.select(
        "table_id",
        "relation",
        F.size("relation").alias("height"),
        F.array_max(F.transform("relation", F.size)).alias("width"),
    ).where((F.col("height") > 0) & (F.col("width") > 0))
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    flipped = F.transform(columns, lambda j: F.transform("relation", lambda row: F.get(row, j)))
    padded = F.transform("relation", lambda row: F.transform(columns, lambda j: F.get(row, j)))
    grid = sized.select(
        "table_id", F.when(F.col("width") > F.col("height"), flipped).otherwise(padded).alias("grid")
    ).withColumn("first", F.col("grid")[0])
    has_header = F.forall(
        "first", lambda c: c.isNotNull() & parse_number(c).isNull()
    ) & (F.size(F.array_distinct("first")) == F.size("first"))
    rows = grid.withColumn("has_header", has_header).select(
        "table_id", "has_header", "first", F.posexplode("grid").alias("row", "values")
    )
    body = rows.where(~F.col("has_header") | (F.col("row") > 0))
    cells = body.select(
        "table_id",
        (F.col("row") - F.col("has_header").cast("int")).cast("long").alias("row_id"),
        "has_header",
        "first",
        F.posexplode("values").alias("column_id", "cell"),
    )
    name = F.when(F.col("has_header"), F.get("first", F.col("column_id"))).otherwise(
        F.col("column_id").cast("string")
    )
    return cells.withColumn("column_name", name).withColumn(
        "num", parse_number(F.col("cell"))
    ).select(*CELL_COLUMNS)


def parse_relations(lines: DataFrame) -> DataFrame:
    """``relation`` of JSON lines ``(table_id, value)``; NULL where the line is broken."""
    parsed = F.from_json("value", "relation array<array<string>>").getField("relation")
    return lines.select("table_id", parsed.alias("relation"))


def read_web_tables(spark: SparkSession, path: str, pattern: str = "*.json.gz") -> CellSource:
    """Web tables from JSON lines, gzip or plain; ids are made of chunk number and line."""
    lines = numbered_lines(_text_lines(spark, path, pattern))
    chunk = F.regexp_extract("path", r"(\d+)\.json(\.gz)?$", 1).cast("int")
    named = lines.select(
        F.format_string(WEB_TABLE_ID, chunk, F.col("line")).alias("table_id"), "value"
    )
    parsed = parse_relations(named)
    errors = parsed.where(F.col("relation").isNull()).select(
        "table_id", F.lit("no relation in line").alias("error")
    )
    return CellSource(relation_cells(parsed.where(F.col("relation").isNotNull())), errors)


def load_query(df: DataFrame, key: str | int, value: str | int) -> DataFrame:
    """Two-column query ``(key, value)``, by name or position; rows without a value drop out."""
    names = [c if isinstance(c, str) else df.columns[c] for c in (key, value)]
    pair = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    places = [df.columns.index(n) for n in names]
    return pair.select(
        F.col(f"c{places[0]}").cast("string").alias("key"),
        F.col(f"c{places[1]}").cast("double").alias("value"),
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))


def read_query(spark: SparkSession, path: str, key: str | int, value: str | int, separator: str = ";") -> DataFrame:
    """:func:`load_query` of a CSV file."""
    return load_query(spark.read.csv(path, sep=separator, header=True), key, value)


def export_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """Write a result as separated text with a header."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(path)
