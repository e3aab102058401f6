"""The named queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens.llm import (
    exactdedup, filteraudit, language, linededup, lmscore, mixing, neighbours, packing, prefixtrie, quality, sharding, simhash, topk,
)
from vacancylens.llm.common import table

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op2_topk": topk.ORACLE_SQL, "op7_line_dedup": linededup.ORACLE_SQL, "op11_prefix_trie": prefixtrie.ORACLE_SQL,
                       "op12_filter_audit": filteraudit.ORACLE_SQL, "op13_exact_dedup": exactdedup.ORACLE_SQL}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the shard of every time it is taken."""
    rows = mixing.allocate(table(spark, sf_dir, "documents"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every query vector."""
    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between the well-labelled documents and all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and labelled spans of every document."""
    return language.languages(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without their recurring lines."""
    return linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every query vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the key alone decides."""
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie over all rebuilt conversations."""
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does to every source, in all 120 orders."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document, from an index of all texts."""
    rows = exactdedup.resolve(exactdedup.insert(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
