"""Compare queries with their SQL in DuckDB: ``python tests/oracle_check.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("", "null")
    if isinstance(value, float):
        return ("n", repr(value + 0.0))
    if isinstance(value, int):
        return ("n", repr(float(value)))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, query, sql: str, folder: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else ""


if __name__ == "__main__":
    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = contract.queries(), contract.oracle_sql()
    print("no query for", sorted(set(oracle) - set(queries)), flush=True)
    failed = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, queries[name], oracle[name], folder)
            else:
                n = len(queries[name](spark, folder).collect())
                problem = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print("failed:", failed)
