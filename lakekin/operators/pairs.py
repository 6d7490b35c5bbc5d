"""From tables to (pair, key) -> mean rows, the input of every search.

Wide tables and tall cells give the same result. Both aggregate partially
before any shuffle by key, so a key that fills a third of a table travels as
one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.functions.hashing import hash_sql
from lakekin.functions.numeric import clean_text, usable
from lakekin.operators.profile import column_label, table_roles
from lakekin.options import MAX_MEASURE, PAIR, SketchOptions
from lakekin.session import materialize


def quoted(name: str) -> Column:
    """Column reference that survives dots and other marks in ``name``."""
    return F.col(identifier(name))


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def template(text: str) -> str:
    """``text`` made safe inside a ``spark.sql`` template."""
    return text.replace("{", "{{").replace("}", "}}")


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_aggregate(agg: str) -> None:
    if agg != "avg":
        raise ValueError(f"unknown aggregation method {agg!r}; only 'avg' is defined")


@dataclass(frozen=True)
class LakeTable:
    """A wide table of the lake with the roles of its columns."""

    table_id: str
    df: DataFrame
    keys: tuple[str, ...]
    measures: tuple[str, ...]


class LakeSql:
    """SQL over all tables of a lake.

    Key columns are numbered across the lake and travel as that number. Tables
    with the same number of measures are stacked before they are aggregated,
    so a lake needs as many shuffles as there are such numbers, not one per
    table.
    """

    def __init__(
        self,
        lake: Sequence[LakeTable],
        only_keys: DataFrame | None = None,
        limits: Sequence[str] = (),
        hash_digits: str = "",
    ) -> None:
        self.limits = limits
        self.hash_digits = hash_digits
        self.lake = [t for t in lake if t.keys and t.measures]
        if not self.lake:
            raise ValueError("no table has both a key and a measure column")
        self.only_keys = only_keys
        self.first_key = []
        self.places: list[tuple[LakeTable, int]] = []
        for table in self.lake:
            self.first_key.append(len(self.places) + 1)
            self.places += [(table, i) for i in range(len(table.keys))]

    def run(self, sql: str) -> DataFrame:
        frames = {f"t{i}": t.df for i, t in enumerate(self.lake)}
        if self.only_keys is not None:
            frames["few"] = self.only_keys
        return self.lake[0].df.sparkSession.sql(sql, **frames)

    def _lookup(self, values: Sequence[str]) -> str:
        return f"element_at(array({template(', '.join(values))}), CAST(k AS INT))"

    def table_id(self) -> str:
        return self._lookup([literal(t.table_id) for t, _ in self.places])

    def key_col(self) -> str:
        return self._lookup([literal(t.keys[i]) for t, i in self.places])

    def position(self) -> str:
        return self._lookup([str(i) for _, i in self.places])

    def value_col(self) -> str:
        names = [f"array({', '.join(map(literal, t.measures))})" for t, _ in self.places]
        return f"element_at({self._lookup(names)}, CAST(m AS INT))"

    def measure_counts(self) -> list[int]:
        return sorted({len(t.measures) for t in self.lake})

    def _numbered_keys(self, i: int) -> str:
        """UNPIVOT clause that makes the key columns of table i rows and drops missing keys."""
        first = self.first_key[i]
        names = ", ".join(f"k{j} AS `{first + j}`" for j in range(len(self.lake[i].keys)))
        return f"UNPIVOT (key FOR k IN ({names}))"

    def _filtered(self, rows: Sequence[str]) -> str:
        stacked = " UNION ALL ".join(rows)
        if self.limits:
            limit = self._lookup([literal(cut) for cut in self.limits])
            stacked = f"SELECT * FROM ({stacked}) WHERE {self.hash_digits} <= {limit}"
        if self.only_keys is None:
            return stacked
        return (
            f"SELECT /*+ BROADCAST(few) */ l.* FROM ({stacked}) l "
            "LEFT SEMI JOIN {few} few ON l.key = few.key"
        )

    def keys_only(self) -> str:
        """Rows ``(k, key)`` of all key columns."""
        rows = []
        for i, table in enumerate(self.lake):
            columns = ", ".join(
                f"CAST({identifier(k)} AS STRING) AS k{j}" for j, k in enumerate(table.keys)
            )
            rows.append(
                f"SELECT k, key FROM (SELECT {template(columns)} FROM {{t{i}}}) {self._numbered_keys(i)}"
            )
        return self._filtered(rows)

    def long_rows(self, n_measures: int, *, clean_keys: bool = False, min_rows: int = 0) -> str:
        """Rows ``(k, key, m1, m2, ...)`` of the tables with ``n_measures`` measures.

        Measures are NULL where unusable.
        """
        numbers = range(1, n_measures + 1)
        values = ", ".join(f"m{j}" for j in numbers)
        guard = f"CASE WHEN NOT isnan({{0}}) AND abs({{0}}) < {MAX_MEASURE!r}D THEN {{0}} END"
        trim = "lower(regexp_replace({}, '^\\\\s+|\\\\s+$', ''))"
        rows = []
        for i, table in enumerate(self.lake):
            if len(table.measures) != n_measures:
                continue
            keys = [f"CAST({identifier(k)} AS STRING) AS k{j}" for j, k in enumerate(table.keys)]
            casts = [f"CAST({identifier(m)} AS DOUBLE) AS v{j}" for j, m in zip(numbers, table.measures)]
            names = ", ".join(
                f"{trim.format(f'k{j}') if clean_keys else f'k{j}'} AS k{j}" for j in range(len(keys))
            )
            raw = f"SELECT {template(', '.join(keys + casts))} FROM {{t{i}}}"
            guards = ", ".join(f"{guard.format(f'v{j}')} AS m{j}" for j in numbers)
            sql = f"SELECT {names}, {guards} FROM ({raw})"
            sql = f"SELECT k, key, {values} FROM ({sql}) {self._numbered_keys(i)}"
            if min_rows > 1:
                sql += (
                    f" WHERE (SELECT count(*) FROM (SELECT 1 FROM {{t{i}}} LIMIT {min_rows})) >= {min_rows}"
                )
            rows.append(sql)
        return self._filtered(rows)


def lake_means(
    lake: Sequence[LakeTable],
    *,
    min_rows: int = 0,
    clean_keys: bool = False,
    only_keys: DataFrame | None = None,
    limits: Sequence[str] = (),
    hash_digits: str = "",
    agg: str = "avg",
) -> DataFrame:
    """Pair means ``(table_id, key_col, value_col, key, value)`` of all tables, as one plan.

    Key columns become rows before the aggregation and measures after it: a
    row is repeated once per key column, not once per pair. ``only_keys`` (a
    column ``key``, of a checked size) restricts the rows before they are
    aggregated; ``limits`` and ``hash_digits`` come from
    :func:`sketch_candidates`.
    """
    check_aggregate(agg)
    sql = LakeSql(lake, only_keys, limits, hash_digits)
    parts = []
    for n in sql.measure_counts():
        averages = ", ".join(f"avg(m{j}) AS m{j}" for j in range(1, n + 1))
        names = ", ".join(f"m{j} AS `{j}`" for j in range(1, n + 1))
        rows = sql.long_rows(n, clean_keys=clean_keys, min_rows=min_rows)
        parts.append(
            f"SELECT {sql.table_id()} AS table_id, {sql.key_col()} AS key_col, "
            f"{sql.value_col()} AS value_col, key, value "
            f"FROM (SELECT k, key, {averages} FROM ({rows}) GROUP BY k, key) "
            f"UNPIVOT (value FOR m IN ({names}))"
        )
    return sql.run(" UNION ALL ".join(parts))


#: Leading hex digits of a hash, of which :func:`sketch_means` counts the keys.
COUNTED_DIGITS = 3


def sketch_means(lake: Sequence[LakeTable], opts: SketchOptions = SketchOptions(), **options) -> DataFrame:
    """:func:`lake_means` of only the keys that can be in a sketch by ``opts``.

    The lake is read and aggregated once. The means of a pair are counted by the first
    digits of their hash (at most 16^3 rows per task and pair); up to the digits at which
    the count reaches the sketch size there are as many keys, so no key above them can be
    sampled. Counting and dropping both read the same exchange, and neither sorts the
    means, so a task's memory does not grow with the rows of the pairs. Pairs with fewer
    keys stay whole, and so do all of a hash order that is no hex text.
    """
    hash_text = hash_sql(opts)
    if hash_text is None:
        return lake_means(lake, **options)
    sql = LakeSql(lake)
    digits = f"substring({template(hash_text.format('key'))}, 1, {COUNTED_DIGITS})"
    parts = []
    for n in sql.measure_counts():
        averages = ", ".join(f"avg(m{j}) AS m{j}" for j in range(1, n + 1))
        names = ", ".join(f"m{j} AS `{j}`" for j in range(1, n + 1))
        parts.append(
            f"SELECT k, m, key, value, {digits} AS digits "
            f"FROM (SELECT k, key, {averages} FROM ({sql.long_rows(n, **options)}) GROUP BY k, key) "
            f"UNPIVOT (value FOR m IN ({names}))"
        )
    return sql.run(
        f"WITH means AS ({' UNION ALL '.join(parts)}), "
        "counted AS (SELECT k, m, digits, count(*) AS n FROM means GROUP BY k, m, digits), "
        "reached AS (SELECT k, m, digits, sum(n) OVER (PARTITION BY k, m ORDER BY digits) AS upto FROM counted), "
        f"limits AS (SELECT k AS lk, m AS lm, min(digits) AS cut FROM reached WHERE upto >= {opts.size} GROUP BY k, m) "
        # One row per pair of the listed tables.
        f"SELECT /*+ BROADCAST(limits) */ {sql.table_id()} AS table_id, {sql.key_col()} AS key_col, "
        f"{sql.value_col()} AS value_col, key, value FROM means LEFT JOIN limits ON k = lk AND m = lm WHERE cut IS NULL OR digits <= cut"
    )


def restrict(
    lake: Sequence[LakeTable], columns: Iterable[tuple[str, ...]]
) -> list[LakeTable]:
    """The part of the lake named by ``(table_id, key_col)`` or ``(table_id, key_col, value_col)``.

    Tables and columns that are not named are not read at all.
    """
    wanted: dict[str, tuple[set, set]] = {}
    for table_id, key_col, *value_col in columns:
        keys, measures = wanted.setdefault(table_id, (set(), set()))
        keys.add(key_col)
        measures.update(value_col)
    kept = []
    for table in lake:
        if table.table_id in wanted:
            keys, measures = wanted[table.table_id]
            kept.append(
                LakeTable(
                    table.table_id,
                    table.df,
                    tuple(k for k in table.keys if k in keys),
                    tuple(m for m in table.measures if not measures or m in measures),
                )
            )
    return kept


def sketch_candidates(
    lake: Sequence[LakeTable], size: int, hash_text: str = "md5({})", **options
) -> DataFrame:
    """:func:`lake_means` of only the keys that can be in a sketch of ``size`` keys.

    For tables with many keys this saves the shuffle of nearly all of them. A
    first pass lists which leading hash digits occur per key column and
    measure (at most 16^4 each). Up to the ``size``-th smallest of these there
    are at least ``size`` keys, so no key above it can be sampled; the second
    pass drops those rows at the scan. ``hash_text`` is SQL for a hex hash.
    """
    sql = LakeSql(lake)
    digits = f"substring({hash_text.format('key')}, 1, 4)"
    parts = []
    for n in sql.measure_counts():
        numbers = range(1, n + 1)
        present = ", ".join(f"max(m{j} IS NOT NULL) AS p{j}" for j in numbers)
        names = ", ".join(f"p{j} AS `{j}`" for j in numbers)
        rows = sql.long_rows(n, **options)
        parts.append(
            f"SELECT k, m, digits FROM (SELECT k, {digits} AS digits, {present} FROM ({rows}) "
            f"GROUP BY k, {digits}) UNPIVOT (present FOR m IN ({names})) WHERE present"
        )
    places = sql.run(
        "SELECT k, m, digits, row_number() OVER (PARTITION BY k, m ORDER BY digits) AS place "
        f"FROM ({' UNION ALL '.join(parts)})"
    )
    # At most one row per key column and measure of the listed tables.
    found = places.where(F.col("place") == size).collect()
    cuts: dict[int, list[str]] = {}
    for row in found:
        cuts.setdefault(int(row["k"]), []).append(row["digits"])
    # A measure without a row has few keys: then its key column is not cut.
    limits = [
        max(cuts[k]) if len(cuts.get(k, [])) == len(table.measures) else "ffff"
        for k, (table, _) in enumerate(sql.places, start=1)
    ]
    return lake_means(lake, hash_digits=digits, limits=limits, **options)


def wide_pair_means(
    df: DataFrame, table_id: str, keys: Sequence[str], measures: Sequence[str], **options
) -> DataFrame:
    """:func:`lake_means` of a single table."""
    return lake_means([LakeTable(table_id, df, tuple(keys), tuple(measures))], **options)


def role_columns(cells: DataFrame, *, label_by: str = "name", **rules) -> DataFrame:
    """Written ``table_no, table_id, column_id, label, is_key`` of the key and measure columns.

    A small table: one row per column. Written first, its size is known when joins
    with the cells are planned. ``table_no`` is a number for this run only.
    """

    def listed(columns: str, is_key: bool) -> Column:
        return F.transform(
            columns,
            lambda c: F.struct(
                c["column_id"].alias("column_id"),
                column_label(c["column_id"], c["column_name"], label_by).alias("label"),
                F.lit(is_key).alias("is_key"),
            ),
        )

    roles = table_roles(cells, **rules)
    both = F.concat(listed("keys", True), listed("measures", False))
    columns = roles.select(F.monotonically_increasing_id().alias("table_no"), "table_id", both.alias("columns"))
    return materialize(columns.select("table_no", "table_id", F.inline("columns")), "roles")


#: Columns of a pair as numbers; names are put in their place last.
NUMBERED = ["table_no", "key_id", "value_id"]


def row_block(block_rows: int) -> Column:
    """Number of the block of rows a cell belongs to."""
    return F.expr(f"row_id DIV {int(block_rows)}").alias("block")


def role_cells(cells: DataFrame, columns: DataFrame, only_keys: DataFrame | None = None) -> DataFrame:
    """``table_no, row_id, column_id, key, value``: key cells with their text, measure cells with their number.

    Cells without a role, missing keys and unusable numbers are dropped where they are read.
    """
    roles = columns.select("table_no", "table_id", "column_id", "is_key")
    found = cells.select("table_id", "row_id", "column_id", "cell", "num").join(roles, ["table_id", "column_id"])
    placed = found.select(
        "table_no",
        "row_id",
        "column_id",
        F.when(F.col("is_key"), F.col("cell")).alias("key"),
        F.when(~F.col("is_key") & usable(F.col("num")), F.col("num")).alias("value"),
    )
    if only_keys is not None:
        few = F.broadcast(only_keys.select(F.col("key").alias("few")).distinct())
        known = placed.join(few, F.col("key") == F.col("few"), "left")
        placed = known.withColumn("key", F.col("few")).drop("few")
    return placed.where("key IS NOT NULL OR value IS NOT NULL")


def numbered_rows(
    cells: DataFrame, columns: DataFrame, only_keys: DataFrame | None = None, block_rows: int = 1 << 16
) -> DataFrame:
    """Rows ``(*NUMBERED, key, value)``: the key cells of a table row beside its measure cells.

    Roles meet the cells before the exchange, so only cells of a role travel, once, as
    numbers and with either their text or their number. The exchange is on (table, block
    of rows), so that one huge table spreads over many tasks, and rows are put together on it. ``only_keys`` (a column
    ``key``, of a checked size) drops other keys where they are read.
    """
    value = F.when(F.col("value").isNotNull(), F.struct(F.col("column_id").alias("value_id"), "value"))
    # The row id first: it tells rows apart where they are sorted. A window sorts once;
    # a group by with lists would sort before and after merging them.
    beside = Window.partitionBy("row_id", "table_no", "block")
    rows = (
        role_cells(cells, columns, only_keys)
        .withColumn("block", row_block(block_rows))
        .repartition("table_no", "block")
        .withColumn("measures", F.collect_list(value).over(beside))
        .where(F.col("key").isNotNull())
    )
    opened = rows.select("table_no", F.col("column_id").alias("key_id"), "key", F.inline("measures"))
    return opened.select(*NUMBERED, "key", "value")


def named_pairs(numbered: DataFrame, columns: DataFrame) -> DataFrame:
    """Names in place of the numbers of a pair; other columns stay."""
    rest = [c for c in numbered.columns if c not in NUMBERED]
    keys = columns.where("is_key").select("table_no", "table_id", F.col("column_id").alias("key_id"), F.col("label").alias("key_col"))
    measures = columns.where("NOT is_key").select("table_no", F.col("column_id").alias("value_id"), F.col("label").alias("value_col"))
    named = numbered.join(keys, ["table_no", "key_id"]).join(measures, ["table_no", "value_id"])
    return named.select(*PAIR, *rest)


def cell_pair_rows(
    cells: DataFrame,
    *,
    rule: str = "strict",
    null_as_nan: bool = True,
    min_rows: int = 2,
    block_rows: int = 1 << 16,
    label_by: str = "name",
) -> DataFrame:
    """One row per (table row, key column, measure column) of a tall lake.

    The cells are read twice: for the roles, which are found at once, and for the rows.
    """
    columns = role_columns(cells, rule=rule, null_as_nan=null_as_nan, min_rows=min_rows, label_by=label_by)
    return named_pairs(numbered_rows(cells, columns, block_rows=block_rows), columns)


def cell_pair_aggregate(
    cells: DataFrame,
    *aggregates: Column,
    clean_keys: bool = False,
    only_keys: DataFrame | None = None,
    block_rows: int = 1 << 16,
    **rules,
) -> DataFrame:
    """``aggregates`` of ``value`` per pair and key; pairs are named after it.

    ``rules`` and ``block_rows`` are those of :func:`cell_pair_rows`.
    """
    columns = role_columns(cells, **rules)
    rows = numbered_rows(cells, columns, only_keys, block_rows)
    if clean_keys:
        rows = rows.withColumn("key", clean_text(F.col("key")))
    return named_pairs(rows.groupBy(*NUMBERED, "key").agg(*aggregates), columns)


def cell_pair_means(cells: DataFrame, *, clean_keys: bool = False, agg: str = "avg", **rules) -> DataFrame:
    """:func:`wide_pair_means` for a tall lake of any number of tables.

    ``rules`` are those of :func:`cell_pair_rows`.
    """
    check_aggregate(agg)
    return cell_pair_aggregate(cells, F.avg("value").alias("value"), clean_keys=clean_keys, **rules)


def query_means(
    df: DataFrame, key: str, value: str, *, clean_keys: bool = False, table_id: str = "query"
) -> DataFrame:
    """A two-column query table as pair means."""
    return wide_pair_means(df, table_id, [key], [value], clean_keys=clean_keys)
