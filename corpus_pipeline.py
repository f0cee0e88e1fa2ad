"""A document pipeline: language ID, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next one's docs. SQL cannot express the stages (a trained model,
connected classes, a tokenizer), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm import langid, mixing, packing, pii, shared, simhash
from trialframe.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return langid.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_one_of_each_class(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of the sources by target weights takes them."""
    return mixing.apply_mix(docs)


def hilbert_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.with_crc32(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("pii_redaction", pii_redaction),
    ("source_mix", source_mix),
    ("hilbert_packing", hilbert_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
