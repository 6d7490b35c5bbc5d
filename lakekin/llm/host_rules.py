"""Host-level quality rules.

Every document is measured; failures are counted per host; the hosts' failure
rates are shrunk towards the corpus by an empirical beta prior; and the hosts'
verdicts are joined back to their documents.

Defined results: a null text has no words and fails; a null host is a host of its
own; repeated rows count as often as they occur; an empty table gives an empty
result. Lines and word windows are equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekin.llm import text as tx
from lakekin.session import materialize

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

#: A host is rejected when its shrunken failure rate is above this.
HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents; used as they are when hosts do not differ.
PRIOR_WEIGHT = (2.0, 1000.0)


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The :data:`MEASURES` of every text of a block."""
    data, offsets = tx.utf8(texts)
    n = len(offsets) - 1
    starts, ends = tx.spans(data, offsets, tx.SPACE)
    doc = tx.owners(offsets, starts)
    n_words = np.bincount(doc, minlength=n)
    inside = ~tx.SPACE[data]
    chars = tx.per_text(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = tx.per_text(SYMBOLS[data], offsets)

    # Lines with a word; a line counts as repeated when an earlier one is equal.
    first, last = tx.spans(data, offsets, tx.NEWLINE)
    filled = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[filled], last[filled]
    line_doc = tx.owners(offsets, first)
    n_lines = np.bincount(line_doc, minlength=n)
    tag = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    line = tx.span_hashes(data, first, last) ^ tag[line_doc]
    distinct = np.unique(line, return_index=True)[1]
    dup_lines = n_lines - np.bincount(line_doc[distinct], minlength=n)

    # Windows of three words that the text holds at least twice, and the words in them.
    covered = np.zeros(len(starts), bool)
    if len(starts) > 2:
        word = tx.span_hashes(data, starts, ends)
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        window = tx.mix(word[whole] * np.uint64(3) + tx.mix(word[whole + 1] + np.uint64(1)) * np.uint64(5) + tx.mix(word[whole + 2] + np.uint64(2)) * np.uint64(7))
        window ^= tag[doc[whole]]
        _, at, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = whole[count[at] > 1]
        for step in range(3):
            covered[twice + step] = True
    repeated = np.bincount(doc[covered], minlength=n)
    return [x.astype(np.int64) for x in (n_words, chars, symbols, n_lines, dup_lines, repeated)]


def with_measures(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with one struct column ``name`` of measures; other columns unchanged."""
    kind = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind, False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, text_col):
                found = measure(part.column(text_col))
                struct = pa.StructArray.from_arrays([pa.array(x) for x in found], list(MEASURES))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, name])

    return docs.mapInArrow(tx.tidy(work), schema)


def base_failed(m: str) -> Column:
    """Too few words, or more than half of the words in repeated windows."""
    n = F.col(f"{m}.n_words")
    return (n < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * n)


def own_failed(m: str) -> Column:
    """Rules of the document itself: symbols and word length.

    Repeated lines are measured but no rule: clean documents may quote a line often,
    and a text of repeats has too many repeated words already.
    """
    n, chars = F.col(f"{m}.n_words"), F.col(f"{m}.word_chars")
    return (10 * F.col(f"{m}.n_symbols") > n) | (chars < 2 * n) | (chars > 12 * n)


def host_verdicts(measured: DataFrame, host_col: str, m: str, rate: float = HOST_RATE) -> DataFrame:
    """``host, host_docs, host_failures, host_rate, host_rejected`` per host.

    The beta prior comes from the moments of all hosts' rates. Counts leave each
    task as one row per host, so a hot host is no burden; only the two prior
    figures reach the driver.
    """
    failed = (base_failed(m) | own_failed(m)).cast("long")
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("host_docs"), F.sum(failed).alias("host_failures")
    )
    hosts = materialize(hosts, "hosts")
    share = F.col("host_failures") / F.col("host_docs")
    row = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("mean"),
        F.var_samp(share).alias("spread"),
        F.avg(1 / F.col("host_docs")).alias("noise"),
    ).first()
    mean = row["mean"] or 0.0
    # Variance between hosts, less what counting alone would give.
    between = (row["spread"] or 0.0) - mean * (1 - mean) * (row["noise"] or 0.0)
    low, high = PRIOR_WEIGHT
    weight = min(high, max(low, mean * (1 - mean) / between - 1)) if between > 0 else high
    shrunk = (F.col("host_failures") + F.lit(weight * mean)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: measures, ``base_failed``, its host's figures, ``kept``.

    A document is kept when neither its own rules nor its host's verdict reject it.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = materialize(with_measures(narrow, "text", "m").drop("text"), "measures")
    hosts = host_verdicts(measured, "host", "m").withColumnRenamed("host", "of_host")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    failed = base_failed("m")
    return joined.select(
        "doc_id",
        "host",
        "m.*",
        failed.alias("base_failed"),
        "host_rate",
        "host_rejected",
        (~failed & ~own_failed("m") & ~F.col("host_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that :func:`judge` keeps, all columns unchanged.

    Texts are measured twice instead of being shuffled to meet their verdict.
    """
    m, host = "__measures", "__host"
    narrow = docs.select(F.col(host_col).alias(host), F.col(text_col).alias("text"))
    bad = host_verdicts(with_measures(narrow, "text", m), host, m)
    bad = bad.filter("host_rejected").select(F.col("host").alias(host))
    kept = with_measures(docs, text_col, m).filter(~base_failed(m) & ~own_failed(m))
    return kept.join(bad, kept[host_col].eqNullSafe(bad[host]), "left_anti").select(*docs.columns)
