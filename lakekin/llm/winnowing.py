"""Line deduplication by winnowing, with DataFrame operations only.

A document is the sequence of its filled lines. Of every window of consecutive line
hashes the smallest is the fingerprint; shorter windows count when their lines have
many words together. Two documents that share such a run share its fingerprint and the
hashes around it. Every later occurrence meets the first one of the same fingerprint
between the same lines, so a line that first stands elsewhere hides no repeated run.
A match gives a diagonal between two documents, along which it is extended both ways
over the neighbouring matches; of each run the later place is deleted.

A deleted line always has an equal line at an earlier place, so nothing is lost
altogether. Earlier means: smaller id (null last), then hash of the text, then line.

Defined results: a null text has no lines; blank lines are no part of any run and
stay; white space at the ends of a line and its amount inside do not matter; rows
repeated with equal id and text count as one document; an empty table gives an
empty result. Lines are equal when 60 bits of their MD5 are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.session import materialize

#: Lines of a window, and of the shortest run that is deleted for its lines.
WINDOW = 3
#: A run of so many words in all its lines is deleted however short.
LONG_WORDS = 50
GAP = r"[\x20\x09-\x0D]+"
FILLED = r"[^\x20\x09-\x0D][^\n]*"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, GAP, " "))


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, lines``: hash, words and place in the text of each filled line."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    tidied = F.transform(split, lambda line, i: F.struct(tidy(line).alias("t"), i.alias("at")))
    filled = F.filter(tidied, lambda x: x["t"] != "")
    lines = F.transform(
        filled,
        lambda x: F.struct(
            line_hash(x["t"]).alias("h"),
            (F.length(x["t"]) - F.length(F.replace(x["t"], F.lit(" "), F.lit(""))) + 1).cast("int").alias("words"),
            x["at"].alias("at"),
        ),
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), lines.alias("lines"))


def contexts(lines: Column, window: int, long_words: int) -> Column:
    """``i, fp, around, start, size``: the fingerprint of every shortest run that is deleted.

    These are all windows, and all shorter runs that have ``long_words`` together.
    ``around`` tells apart the runs that one fingerprint stands in.
    """

    def mark(size: int, start: Column) -> Column:
        part = F.slice(lines, start + 1, F.lit(size))
        least = F.array_min(F.transform(part, lambda x, k: F.struct(x["h"].alias("h"), (-k).alias("k"))))
        around = F.xxhash64(F.transform(part, lambda x: x["h"]))
        i = (start - least["k"]).alias("i")
        return F.struct(i, least["h"].alias("fp"), around.alias("around"), start.alias("start"), F.lit(size).alias("size"))

    def of_size(size: int) -> Column:
        starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        if size < window:
            words = lambda start: F.aggregate(F.slice(lines, start + 1, F.lit(size)), F.lit(0), lambda n, x: n + x["words"])
            starts = F.filter(starts, lambda start: words(start) >= long_words)
        return F.transform(starts, lambda start: mark(size, start))

    return F.concat(*[of_size(size) for size in range(1, window + 1)])


def repeated_runs(stored: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id, th, first, last``: line indexes of the runs to delete."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", F.col("i"))
    marks = stored.select("doc_id", "th", F.explode(contexts(F.col("lines"), window, long_words)).alias("m"))
    marks = marks.select("doc_id", "th", "m.i", "m.start", "m.size", F.struct("m.fp", "m.around", "m.size").alias("fp"))
    firsts = marks.groupBy("fp").agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1")
    # Written, so that both sides of the join are dealt out for it alone and the
    # occurrences of a very common fingerprint can be split over tasks.
    firsts = materialize(firsts.select("fp", "f"), "firsts")
    met = marks.join(firsts.hint("merge"), "fp").filter(place != F.col("f"))
    matches = met.select(
        "doc_id",
        "th",
        F.col("f.doc_id").alias("a_id"),
        F.col("f.th").alias("a_th"),
        (F.col("i") - F.col("f.i")).alias("shift"),
        F.col("start").alias("first"),
        (F.col("start") + F.col("size") - 1).alias("last"),
    )
    # One exchange, by document, serves the extension here and the caller's grouping.
    diagonal = ["doc_id", "th", "a_id", "a_th", "shift"]
    along = Window.partitionBy(*diagonal).orderBy("first", "last")
    reached = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") <= reached + 1, 0).otherwise(1)
    runs = matches.repartition("doc_id", "th").withColumn("begins", begins).withColumn("run", F.sum("begins").over(along))
    return runs.groupBy(*diagonal, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(
        "doc_id", "th", "first", "last"
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_deleted, text``: every document without its repeated runs.

    ``n_lines`` counts filled lines. Deleted lines go with the line break after them.
    """
    stored = materialize(sequences(docs, id_col, text_col), "lines")
    once = stored.dropDuplicates(["doc_id", "th"])
    runs = repeated_runs(once).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    lines = once.join(
        runs.withColumnsRenamed({"doc_id": "r_id", "th": "r_th"}),
        (F.col("th") == F.col("r_th")) & F.col("doc_id").eqNullSafe(F.col("r_id")),
    )
    # Line numbers in the text of every deleted line.
    inside = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    gone = F.transform(F.array_distinct(inside), lambda i: F.element_at("lines", i + 1)["at"])
    gone = materialize(lines.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), gone.alias("gone")), "deleted")
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # Documents with deletions grow with the corpus: planned alike at every size.
    joined = keyed.join(gone.hint("merge"), (F.col("th") == F.col("g_th")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    split = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.transform(stay, lambda i: F.element_at(split, i + 1))
    cleaned = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.regexp_count("text", F.lit(FILLED)), F.lit(0))
    return joined.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        cleaned.alias("text"),
    )
