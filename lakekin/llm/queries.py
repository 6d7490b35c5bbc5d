"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekin.llm import (
    bpe_trie,
    exact_dedup,
    host_rules,
    line_blocks,
    lsh_forest,
    merkle,
    mixing,
    packing,
    secret_cnn,
    sharding,
    warc_revisit,
    whitening,
    winnowing,
)
from lakekin.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: File of the vocabulary in the folder of public tokenizers.
VOCABULARY = "word_bpe_49k.json"

REGISTRY: dict[str, Query] = {}


def register(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed tokenizer files are, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@register
def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encoded(table(spark, sf_dir, "documents"), vocabulary_path(), "text", ["doc_id"])


@register
def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages"))


@register
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@register
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumn("host_rate", F.round("host_rate", 6))


@register
def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents"))


@register
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_cnn.scan(docs, secret_cnn.fit(docs))


@register
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages as WARC records, parsed and resolved."""
    captures = warc_revisit.parse_records(warc_revisit.captures_of_pages(table(spark, sf_dir, "pages")))
    found = warc_revisit.resolve(captures)
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    date = F.date_format("warc_date", "yyyy-MM-dd HH:mm:ss")
    return found.withColumns({"headers": F.array_join(lines, "\n"), "warc_date": date})


@register
def op3_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed and written as matrices; the digests are of what was written."""
    packed = materialize(packing.pack_documents(table(spark, sf_dir, "documents")), "packed")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return packed.select(
        "shard",
        "row",
        "n_ids",
        F.size("doc_ids").cast("long").alias("n_segments"),
        joined("doc_ids").alias("doc_ids"),
        joined("starts").alias("starts"),
        joined("cumulative").alias("cumulative"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )


@register
def op6_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.sibling_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register
def op13_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts dealt to eight shards so that bytes are level."""
    found = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
