"""A Merkle manifest of a dataset: a tree per source, and a tree over the sources.

Every node is one row ``(tree, pos, hash, n)``: its place in its level and how many
nodes that level has. One level up, conditional aggregates over the children of a
parent (the slot pivot) spread their hashes into :data:`FANOUT` columns. All columns
joined give the parent's hash; the columns left and right of a child's own slot are
its siblings, the step of its proof at that level.

:data:`STOREY` levels share one exchange: rows are dealt by the block of leaves below
one node that many levels up, so a task never holds more than ``FANOUT ** STOREY``
nodes of one parent, however large the source. Between storeys only the block tops
are written, one row in 729. Proofs run down the same storeys: each block's rest of
the path, up to the root, joins the nodes of that block.

Defined results: nulls hash as ``-``; of equal ids the leaf hash decides the order, a
null id comes first and is never tampered with; rows repeated whole are leaves of
their own; a null source is a tree of its own and comes first; an empty table gives no
rows. Columns other than the five hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekin.llm.order import numbered
from lakekin.session import materialize

FANOUT = 3
#: Levels of the tree that share one exchange.
STOREY = 6
BLOCK = FANOUT**STOREY
#: The hashed columns of a document, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows hash the same input."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(sized)


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, tree, leaf, shown`` per document; ``shown`` is the leaf of the possibly tampered row.

    Where the CRC of the decimal id is even, tampering takes the line ends out of the
    text. Texts are read here and go no further.
    """
    id_col, source, *_, text = fields
    values = [F.col(f) for f in fields]
    tampered = [*values[:-1], F.replace(F.col(text), F.lit("\n"), F.lit(""))]
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    original = leaf_hash(values)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        # Sorts as the source does, nulls first, and is never null.
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("tree"),
        original.alias("leaf"),
        F.when(even, leaf_hash(tampered)).otherwise(original).alias("shown"),
    )


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``block`` and ``steps``; ``hash`` and ``n`` become those of the block's top.

    A tree that has one node left stays as it is for the rest of the storey.
    """
    at = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).repartition("tree", "block")
    kept = [f"`{c}`" for c in at.columns if c != "hash"]
    slots = range(FANOUT)
    children = ", ".join(f"child{j}" for j in slots)
    for level in range(STOREY):
        width = FANOUT**level
        slot = f"pos div {width} % {FANOUT}"
        run = f"(PARTITION BY tree, block, pos div {width * FANOUT})"
        pivoted = at.selectExpr("*", *[f"coalesce(max(CASE WHEN {slot} = {j} THEN hash END) OVER {run}, '') AS child{j}" for j in slots])
        left = ", ".join(f"if({slot} > {j}, child{j}, '')" for j in slots)
        right = ", ".join(f"if({slot} < {j}, child{j}, '')" for j in slots)
        step = f"CASE WHEN n > {width} THEN named_struct('left', concat({left}), 'right', concat({right})) END AS step{level}"
        above = f"CASE WHEN n > {width} THEN sha2(concat({children}), 256) ELSE hash END AS hash"
        at = pivoted.selectExpr(*kept, step, above)
        kept.append(f"step{level}")
    steps = ", ".join(f"step{level}" for level in range(STOREY))
    plain = [c for c in kept if c != "`n`" and not c.startswith("step")]
    return at.selectExpr(*plain, "hash", f"(n + {BLOCK - 1}) div {BLOCK} AS n", f"array_compact(array({steps})) AS steps")


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """The written floors of every storey, from ``nodes`` up to one node per tree."""
    floors = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while len(floors) == 1 or most > 1:
        tops = climb(floors[-1].select("tree", "pos", "hash", "n")).groupBy("tree", "block")
        tops = tops.agg(F.max("hash").alias("hash"), F.max("n").alias("n"))
        tops = tops.select("tree", F.col("block").alias("pos"), "hash", "n")
        floors.append(materialize(tops, "merkle-floor"))
        most = -(-most // BLOCK)
    return floors


def descend(floors: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the lowest floor with their whole proof.

    ``above`` has ``tree, block`` of the top floor, the ``rest`` of the path beyond it,
    and any columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("tree", "block", "rest")]
    for depth, floor in enumerate(reversed(floors[:-1])):
        lowest = depth == len(floors) - 2
        keep = [c for c in floor.columns if c not in ("tree", "pos", "hash", "n")] if lowest else []
        joined = climb(floor).join(above, ["tree", "block"])
        above = joined.select(
            "tree",
            F.col("pos").alias("block"),
            F.concat("steps", "rest").alias("rest"),
            *handed,
            *keep,
        )
    return above


def sibling_digest(steps: Column) -> Column:
    joined = F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")
    return F.sha2(joined, 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings along its path lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, leaf, subroot, root, steps, folded_root, verified`` for every document."""
    rows = materialize(leaves(docs, fields), "merkle-leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    base = numbered(rows, "tree", order, "merkle-order").withColumn("hash", F.col("leaf"))
    floors = ascend(base)
    subroots = floors[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("hash").alias("subroot"))
    sources = numbered(subroots, "tree", [F.col("of").asc()], "merkle-sources").withColumn("hash", F.col("subroot"))
    upper = ascend(sources)
    root = upper[-1].select("tree", F.col("pos").alias("block"), F.array().cast(STEPS).alias("rest"), F.col("hash").alias("root"))
    proven = descend(upper, root)
    above = materialize(proven.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "rest", "root", "subroot"), "merkle-subroots")
    found = descend(floors, above)
    folded = found.withColumn("folded_root", fold(F.col("shown"), F.col("rest")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("rest").alias("steps"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
