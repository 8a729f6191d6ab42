"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays,
sources are mixed to tempered weights (each document at least once, the smallest sources
up to twice) and put in the order of the block permutations, and the result is packed
into windows of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import line_dedup, minmax_dedup, mixing, packing, toxicity
from stratalith.llm.common import stash, table
from stratalith.llm.registry import tokenizer_path
from stratalith.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows, also those left without a line; n_chars follows the text."""
    ship(spark)
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minmax_dedup.keep_one(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    shown = mixing.mixture(docs, tokens=packing.n_tokens(tokenizer_path(), F.col("text")))
    return mixing.realised(shown).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Learnt scores, banding and vocabularies have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = stash(docs)
    return docs
