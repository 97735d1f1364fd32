"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casejobs.llm import durable, mixing, near_dedup, quality_rules, secret_scan, sentencepiece_codec


def _packed(docs: DataFrame) -> DataFrame:
    """A stage's input in parts of some 10,000 rows: what the stage before wrote in many small files is read together."""
    return durable.few_parts(docs, docs.count(), durable.TEXT_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_quality(_packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.one_of_each(_packed(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    clean = secret_scan.redact_secrets(_packed(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as its source's rate says."""
    return mixing.emit(_packed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (with the end id), and digests of the ids and of the decoded text."""
    coded = sentencepiece_codec.sentencepiece_encode(_packed(docs), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", deduplicate),
    ("secret scan", redact),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the sampling of near-dedup nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable.written(docs)
    return docs
