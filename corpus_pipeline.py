"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.llm import decontam, langid, neardup, packing, pii
from runsight.queries import table
from runsight.session import materialize, short_lived


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 per cent of its five-word shingles."""
    return neardup.deduplicate(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, where it is there, follows the text."""
    masked = pii.mask_documents(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, as pieces of documents. Workers live on through the stages, so their encoders remember fewer words here."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, remembered=100_000)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("pack", pack)]
#: A trained network, MinHash and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's result is written to the shared folder and read again; what a stage wrote for itself is removed after it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with short_lived(spark):
            docs = materialize(stage(spark, docs, sf_dir), lasting=True)
    return docs
