"""Documents to packed training sequences: five stages, each written before the next reads it.

Nulls, empty and very long texts, ties, repeated rows and extra columns go through each stage as its operator's module says; an
empty table gives an empty table. A stage's table is deleted once the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import mixing, neardup, packing, quality, secrets
from strandloom.llm.queries import vocabulary
from strandloom.llm.scratch import forget, materialize


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample leaves out go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.importance_resample(docs, labels, keep_columns=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their 5-word shingles stays."""
    return neardup.deduplicate_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack_documents(docs, vocabulary(), keep_ids=False)


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The quality model, fingerprints and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
            if i > 0:
                forget(before)
    return docs
