"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages the
rows are written as Parquet and read again. All stages but the last keep the columns
of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakekin.llm import bpe_trie, exact_dedup, host_rules, lsh_forest, mixing
from lakekin.llm.queries import table, vocabulary_path
from lakekin.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host's verdict keep."""
    return host_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first document."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return lsh_forest.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per pass of their source, the last one cut to the budget."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests, one row per row of the mix."""
    return bpe_trie.encoded(docs, vocabulary_path(), "text", ["doc_id", "source"], with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("source mix", source_mix),
    ("BPE", token_ids),
]

#: Near duplicates and encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.lower().replace(' ', '-')}")
    return docs
