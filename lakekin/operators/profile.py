"""Column roles of the tables in a tall lake, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("strict", "dtype")


def key_columns(df: DataFrame) -> list[str]:
    """Text columns of a wide table."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def measure_columns(df: DataFrame) -> list[str]:
    """Numeric columns of a wide table."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_label(column_id: Column, column_name: Column, label_by: str = "name") -> Column:
    """Text name of a column: its header, or its position when asked or unnamed."""
    position = column_id.cast("string")
    return position if label_by == "position" else F.coalesce(column_name, position)


def role_of(rule: str, null_as_nan: bool) -> Column:
    """Role of a column by its counters (see :func:`column_profile`)."""
    if rule == "strict":
        numbers = F.col("n_numbers")
        if null_as_nan:
            numbers = numbers + F.col("n_missing")
        return F.when(numbers == F.col("n_cells"), "measure").when(numbers == 0, "key")
    text = F.col("n_cells") - F.col("n_numbers") - F.col("n_missing")
    return F.when(text > 0, "key").when(F.col("n_numbers") > 0, "measure")


def column_profile(cells: DataFrame, *, rule: str = "strict", null_as_nan: bool = True) -> DataFrame:
    """Counts and role (``key``, ``measure`` or NULL) of every column.

    ``strict``: a measure column has only numbers, a key column has none.
    With ``null_as_nan`` a missing cell reads ``nan`` and so is a number.
    ``dtype``: any text cell makes a key column, otherwise it is a measure.
    """
    if rule not in RULES:
        raise ValueError(f"unknown column rule {rule!r}")
    missing = F.col("cell").isNull() & F.col("num").isNull()
    # The name is a grouping key: as an aggregate, text would force a sort of all cells.
    counts = cells.groupBy("table_id", "column_id", "column_name").agg(
        F.count("*").alias("n_cells"),
        F.count("num").alias("n_numbers"),
        F.count_if(missing).alias("n_missing"),
    )
    return counts.withColumn("role", role_of(rule, null_as_nan))


def table_stats(cells: DataFrame) -> DataFrame:
    """Rows and columns of every table.

    Distinct rows are found per (table, row) first; the final count then sums
    small partial results, also for a table that fills most of the lake.
    """
    rows = (
        cells.groupBy("table_id", "row_id")
        .agg(F.max("column_id").alias("last"))
        .groupBy("table_id")
        .agg(F.count("*").alias("n_rows"))
    )
    columns = (
        cells.groupBy("table_id", "column_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("table_id")
        .agg(F.count("*").alias("n_columns"))
    )
    return rows.join(columns, "table_id")


def large_tables(cells: DataFrame, min_rows: int) -> DataFrame:
    """Ids of tables with at least ``min_rows`` rows.

    Every row of a table has a cell in each column, so the fullest column
    counts the rows without a distinct over row ids.
    """
    return (
        cells.groupBy("table_id", "column_id")
        .agg(F.count("*").alias("n"))
        .groupBy("table_id")
        .agg(F.max("n").alias("n_rows"))
        .where(F.col("n_rows") >= min_rows)
        .select("table_id")
    )


def table_roles(
    cells: DataFrame, *, rule: str = "strict", null_as_nan: bool = True, min_rows: int = 2,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Per table the ids of its key and measure columns; tables without a pair drop out.

    The lists are as long as the table is wide. ``profile`` is the :func:`column_profile`
    of the cells, where it is written already.
    """
    if profile is None:
        profile = column_profile(cells, rule=rule, null_as_nan=null_as_nan)
    named = F.struct("column_id", "column_name")
    roles = profile.groupBy("table_id").agg(
        F.max("n_cells").alias("n_rows"),
        F.collect_list(F.when(F.col("role") == "key", named)).alias("keys"),
        F.collect_list(F.when(F.col("role") == "measure", named)).alias("measures"),
    )
    roles = roles.where(
        (F.col("n_rows") >= min_rows) & (F.size("keys") > 0) & (F.size("measures") > 0)
    ).withColumn("all", F.concat("keys", "measures"))

    def distinct(columns: str) -> Column:
        """A later column of a name that the table has already gets its number added."""

        def renamed(x: Column) -> Column:
            earlier = F.exists(
                "all", lambda y: (y["column_name"] == x["column_name"]) & (y["column_id"] < x["column_id"])
            )
            name = F.when(earlier, F.concat(x["column_name"], F.lit("#"), x["column_id"].cast("string")))
            return F.struct(x["column_id"].alias("column_id"), name.otherwise(x["column_name"]).alias("column_name"))

        return F.transform(columns, renamed)

    roles = roles.select("table_id", distinct("keys").alias("keys"), distinct("measures").alias("measures"))
    return roles.select(
        "table_id",
        "keys",
        "measures",
        F.col("keys.column_id").alias("key_ids"),
        F.col("measures.column_id").alias("measure_ids"),
        F.map_from_entries(F.concat("keys", "measures")).alias("names"),
    )


def column_pairs(
    cells: DataFrame,
    *,
    rule: str = "strict",
    null_as_nan: bool = True,
    min_rows: int = 2,
    label_by: str = "name",
) -> DataFrame:
    """Every (key column, measure column) pair of every large enough table."""
    roles = table_roles(cells, rule=rule, null_as_nan=null_as_nan, min_rows=min_rows)
    pairs = roles.select("table_id", F.explode("keys").alias("k"), "measures").select(
        "table_id", "k", F.explode("measures").alias("v")
    )
    return pairs.select(
        "table_id",
        column_label(F.col("k.column_id"), F.col("k.column_name"), label_by).alias("key_col"),
        column_label(F.col("v.column_id"), F.col("v.column_name"), label_by).alias("value_col"),
    )
