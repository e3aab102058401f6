"""A training-data pipeline over `documents`: quality, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens.llm import linededup, mixing, packing, quality, simhash
from vacancylens.llm.common import saved, table

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None  # a trained classifier, fingerprints and a tokenizer have no SQL form


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(F.col("text"), model) >= 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that two documents or more hold; a document that held nothing else goes."""
    rows = linededup.drop_repeated_lines(docs, min_docs=2)
    changed = F.col("dropped_lines") > 0
    return rows.filter(~F.coalesce(linededup.all_lost(rows), F.lit(False))).withColumn(
        "n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for every time a document is taken, in shards that are shuffled locally."""
    return mixing.draw(docs, saved(mixing.allocate(docs), "mix-allocation"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 4096 tokens."""
    return packing.pack(docs, str(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
