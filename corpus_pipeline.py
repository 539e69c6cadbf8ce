"""Training-data pipeline: documents in, token ids out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's ``docs``. All but the last keep the columns of ``documents``. Each stage judges all rows of its
input: a row that a filter does not reject is kept as it is, null texts are rejected by the first stage for want of words,
repeated rows meet in the second.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, decontamination, near_copies, pii, quality
from parley.llm.common import written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that base rules and compression bands keep."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Links are those of the SimHash operator (fingerprints that differ in at most two bits), and beyond them texts whose five-word
    shingles have a Jaccard similarity of 0.8.
    """
    return near_copies.one_of_each(docs, fingerprints=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that benchmark passages do not contaminate."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data and ``n_chars`` of the new text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit) with their SHA-256, and the text that they decode to."""
    return bpe.encode_and_decode(docs, VOCABULARY).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
        "decoded",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("bpe encoding and decoding", tokens),
]

#: None: DuckDB has no zstandard ratios of chunks and no BPE. tests/llm compares with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
