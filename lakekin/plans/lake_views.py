"""The driver tables as a lake: wide views with declared key and measure columns.

Money is held in whole cents and rates in whole percent, so sums are exact and
do not depend on the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from lakekin.operators.pairs import LakeTable


def _cents(column: str) -> str:
    return f"CAST(floor({column} * 100 + 0.5) AS BIGINT)"


_ORDERS = "{orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"
_ITEMS = f"{{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey"

#: table id -> (view, key columns, measure columns)
VIEWS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "customer": (
        f"SELECT c_name, c_mktsegment, {_cents('c_acctbal')} AS acctbal FROM {{customer}}",
        ("c_name", "c_mktsegment"),
        ("acctbal",),
    ),
    "cust_orders": (
        "SELECT c_name, o_orderpriority, o_orderstatus, "
        f"{_cents('o_totalprice')} AS totalprice FROM {_ORDERS}",
        ("c_name", "o_orderpriority", "o_orderstatus"),
        ("totalprice",),
    ),
    "cust_items": (
        "SELECT c_name, l_returnflag, l_linestatus, l_quantity AS quantity, "
        f"{_cents('l_extendedprice')} AS extendedprice, {_cents('l_discount')} AS discount "
        f"FROM {_ITEMS}",
        ("c_name", "l_returnflag", "l_linestatus"),
        ("quantity", "extendedprice", "discount"),
    ),
    "part": (
        f"SELECT p_name, p_brand, p_type, p_size, {_cents('p_retailprice')} AS retailprice "
        "FROM {part}",
        ("p_name", "p_brand", "p_type"),
        ("p_size", "retailprice"),
    ),
    "part_sales": (
        "SELECT p_name, p_brand, p_type, l_quantity AS quantity, "
        f"{_cents('l_extendedprice')} AS extendedprice "
        "FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey",
        ("p_name", "p_brand", "p_type"),
        ("quantity", "extendedprice"),
    ),
    "nation_cust": (
        f"SELECT n_name, {_cents('c_acctbal')} AS acctbal "
        "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
        ("n_name",),
        ("acctbal",),
    ),
    "nation_supp": (
        f"SELECT n_name, {_cents('s_acctbal')} AS acctbal "
        "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
        ("n_name",),
        ("acctbal",),
    ),
    "docs": (
        "SELECT lang, source, n_chars FROM {documents}",
        ("lang", "source"),
        ("n_chars",),
    ),
    "doc_labels": (
        "SELECT lang, source, quality, toxic "
        "FROM {documents} d JOIN {labels} b ON d.doc_id = b.doc_id",
        ("lang", "source"),
        ("quality", "toxic"),
    ),
    "events": (
        f"SELECT event_type, {_cents('value')} AS value FROM {{events}}",
        ("event_type",),
        ("value",),
    ),
    "cust_order_totals": (
        "SELECT c_name, count(*) AS n_orders, "
        f"CAST(sum({_cents('o_totalprice')}) AS BIGINT) AS order_total "
        f"FROM {_ORDERS} GROUP BY c_name",
        ("c_name",),
        ("n_orders", "order_total"),
    ),
    "cust_item_totals": (
        "SELECT c_name, count(*) AS n_items, sum(l_quantity) AS qty, "
        f"CAST(sum({_cents('l_extendedprice')}) AS BIGINT) AS revenue, "
        f"avg({_cents('l_discount')}) AS disc FROM {_ITEMS} GROUP BY c_name",
        ("c_name",),
        ("n_items", "qty", "revenue", "disc"),
    ),
}

LAKE_IDS = tuple(VIEWS)

#: The columns in use, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


class Lake:
    """Lazily built views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._sources: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._sources:
            reader = self.spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            self._sources[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._sources[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL in which ``{name}`` is a given frame or a table of the folder."""
        names = {field for _, field, _, _ in Formatter().parse(text) if field}
        sources = {n: frames.get(n) or self.read(n) for n in names}
        return self.spark.sql(text, **sources)

    def table(self, table_id: str) -> LakeTable:
        view, keys, measures = VIEWS[table_id]
        return LakeTable(table_id, self.sql(view), keys, measures)

    def tables(self, ids: Iterable[str] = LAKE_IDS) -> list[LakeTable]:
        return [self.table(i) for i in ids]


#: table id -> (view with ``row_id``, its columns and whether each is text)
CELL_VIEWS: dict[str, tuple[str, tuple[tuple[str, bool], ...]]] = {
    "customer": (
        f"SELECT c_custkey AS row_id, c_name, c_mktsegment, {_cents('c_acctbal')} AS acctbal "
        "FROM {customer}",
        (("c_name", True), ("c_mktsegment", True), ("acctbal", False)),
    ),
    "part": (
        "SELECT p_partkey AS row_id, p_name, p_brand, p_type, p_size, "
        f"{_cents('p_retailprice')} AS retailprice FROM {{part}}",
        (
            ("p_name", True),
            ("p_brand", True),
            ("p_type", True),
            ("p_size", False),
            ("retailprice", False),
        ),
    ),
    "orders": (
        "SELECT o_orderkey AS row_id, o_orderpriority, o_orderstatus, "
        f"{_cents('o_totalprice')} AS totalprice FROM {{orders}}",
        (("o_orderpriority", True), ("o_orderstatus", True), ("totalprice", False)),
    ),
    # The largest table, one row per order and line number.
    "lineitem": (
        "SELECT l_orderkey * 16 + l_linenumber AS row_id, max(l_returnflag) AS l_returnflag, "
        "max(l_linestatus) AS l_linestatus, max(l_suppkey) AS l_suppkey, "
        f"sum({_cents('l_extendedprice')}) AS extendedprice, CAST(sum(l_quantity) AS BIGINT) AS quantity "
        "FROM {lineitem} GROUP BY l_orderkey * 16 + l_linenumber",
        (
            ("l_returnflag", True),
            ("l_linestatus", True),
            ("l_suppkey", False),
            ("extendedprice", False),
            ("quantity", False),
        ),
    ),
    "events": (
        f"SELECT event_id AS row_id, event_type, props, {_cents('value')} AS value FROM {{events}}",
        (("event_type", True), ("props", True), ("value", False)),
    ),
    # A column of mixed content and two measures with missing values.
    "doc_labels": (
        "SELECT d.doc_id AS row_id, lang, source, "
        "CASE WHEN quality IS NULL THEN lang ELSE CAST(n_chars AS VARCHAR(20)) END AS mixed, "
        "n_chars, quality, toxic FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id",
        (
            ("lang", True),
            ("source", True),
            ("mixed", True),
            ("n_chars", False),
            ("quality", False),
            ("toxic", False),
        ),
    ),
    # Too small for the size gate.
    "region": ("SELECT r_regionkey AS row_id, r_name, r_regionkey AS code FROM {region}", (("r_name", True), ("code", False))),
}
