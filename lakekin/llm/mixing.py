"""Mixing sources to target weights, with DataFrame operations only.

Rows get a hash-random key. Within a source, key order is split into ranges; word
counts are summed per (source, range), prefix sums over the ranges find the range
that holds the source's cut, and a prefix sum inside that range alone finds the
cut itself. Everything beyond per-range sums stays where it was read: a row learns
its share by comparing its key with its source's cut.

Defined results: a null text has no words; a null source is a source of its own
and comes last; rows repeated with equal id and text share the words of the cut
evenly; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]*"
#: A source gives at most so many times its own words.
MAX_EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, text: Column) -> Column:
    """60 random bits that a row keeps over all runs."""
    whole = F.concat(F.lit("mix|"), F.coalesce(id_col.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the running total of each of ``sums`` in ``order``, row included.

    Range partitions are written once, so their numbers hold; their totals (one row
    per partition, no more than ``spark.sql.shuffle.partitions``) are summed up and
    broadcast.
    """
    named = df.withColumns({f"__{k}": v for k, v in sums.items()})
    parts = materialize(named.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    before = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)).alias(f"__{k}_before") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(before), "__part")
    return joined.select(*df.columns, *[(F.col(f"__{k}_before") + F.sum(f"__{k}").over(within)).alias(k) for k in sums])


def targets(sized: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, n_docs, source_size, target`` for every source.

    ``share`` of all words is dealt by weight. A source that would give more than
    :data:`MAX_EPOCHS` times its words stops there and the rest is dealt again: in
    order of limit per weight the stopped sources come first, so running totals
    show at once where the level lies.
    """
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * MAX_EPOCHS
    ranked = ranked.select("source", "n_docs", "source_size", weight.alias("weight"), limit.alias("most"))
    order = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    level = materialize(running(ranked, order, {"most_upto": F.col("most"), "weight_upto": F.col("weight")}), "level")
    whole = level.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    goal = float(whole["words"] or 0) * share
    left = F.lit(goal) - (F.col("most_upto") - F.col("most"))
    per_weight = left / (F.lit(float(whole["weight"] or 1)) - (F.col("weight_upto") - F.col("weight")))
    free = level.filter(F.col("most") / F.col("weight") > per_weight)
    found = free.agg(F.min_by(per_weight, F.col("most") / F.col("weight")).alias("level")).first()["level"]
    target = F.col("most").cast("double")
    if found is not None:
        target = F.least(target, F.lit(found) * F.col("weight"))
    return level.select("source", "n_docs", "source_size", target.alias("target"))


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole passes, the key of the cut, and the cut's words and size.

    ``sized`` has ``source, key, size``. Ranges per source are the square root of
    its rows, so neither the list of ranges nor the rows of one range get long.
    """
    goals = goals.withColumn("budget", F.floor("target"))
    goals = goals.withColumn("epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0)))
    goals = goals.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    spread = goals.select(F.col("source").alias("of"), F.ceil(F.sqrt("n_docs")).alias("n_ranges"), "rest")
    number = F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("n_ranges"))
    ranged = sized.join(spread, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", number).drop("of")
    sums = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("in_range"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("upto", F.sum("in_range").over(upto)).filter("upto > rest and upto - in_range <= rest")
    at = at.select(F.col("source").alias("of"), F.col("range").alias("cut_range"), (F.col("rest") - F.col("upto") + F.col("in_range")).alias("inside"))
    # A range with the cut holds about the square root of its source's rows.
    near = ranged.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("cut_range")))
    keys = near.groupBy("source", "key", "inside").agg(F.sum("size").alias("cut_size"))
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("upto", F.sum("cut_size").over(within))
    keys = keys.filter("upto > inside and upto - cut_size <= inside")
    keys = keys.select(F.col("source").alias("of"), F.col("key").alias("cut_key"), "cut_size", (F.col("inside") - F.col("upto") + F.col("cut_size")).alias("cut_words"))
    joined = goals.join(keys, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words")


def partly(size: Column, key: Column) -> Column:
    """Words of a row in the last, partial pass of its source."""
    return (
        F.when(key < F.col("cut_key"), size)
        .when(key == F.col("cut_key"), F.floor(size * F.col("cut_words") / F.col("cut_size")))
        .otherwise(F.lit(0))
        .cast("long")
    )


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        word_count(text).alias("size"),
        F.col(source_col).alias("source"),
        random_key(F.col(id_col), text).alias("key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row."""
    sized = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = materialize(cuts(sized, targets(sized)), "cuts").withColumnRenamed("source", "of")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("epochs") * F.col("size") + partly(F.col("size"), F.col("key"))
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, count: Column) -> Column:
    """The text up to its ``count``-th word, white space as it is."""
    pieces = F.regexp_extract_all(text, F.lit(f"{GAP}{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), count), "")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of the mix: a document once per pass, the cut one shortened to its share.

    ``length_col``, if the table has it, is set anew for shortened texts.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = materialize(cuts(sized, targets(sized)), "cuts")
    plan = plan.select(F.struct(*plan.columns).alias("__cut"))
    text = F.col(text_col)
    keyed = docs.withColumn("__key", random_key(F.col(id_col), text))
    joined = keyed.join(plan, keyed[source_col].eqNullSafe(F.col("__cut.source")))
    at_cut = F.col("__key") == F.col("__cut.cut_key")
    cut_words = F.when(at_cut, F.floor(word_count(text) * F.col("__cut.cut_words") / F.col("__cut.cut_size"))).otherwise(0)
    shares = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("__cut.epochs").cast("int")),
        F.when(F.col("__key") < F.col("__cut.cut_key"), F.array(F.lit(-1).cast("long")))
        .when(cut_words > 0, F.array(cut_words.cast("long")))
        .otherwise(F.array().cast("array<bigint>")),
    )
    rows = joined.withColumn("__share", F.explode(shares))
    shortened = F.col("__share") >= 0
    changed = {text_col: F.when(shortened, first_words(text, F.col("__share").cast("int"))).otherwise(text)}
    rows = rows.withColumns(changed)
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.when(shortened, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)
