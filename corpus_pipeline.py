"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's input.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each component of the Jaccard join on 5-word shingles, linked from 0.8, one document stays.
3. decontaminate: documents that have a window of a benchmark item go.
4. secrets: found credentials are replaced by a mark, and n_chars is counted anew.
5. mix: sources are mixed to their target weights; a row per draw, of whole texts.

Filters judge each row by its own text, also rows without a doc_id and different texts under one. Null and empty texts go at the first stage.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import decontaminate, jaccard, mixing, quality, secrets
from blockloom.llm.common import stored, table, workdir  # noqa: F401 - tests take workdir from here


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_unseen(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: The mix draws by a 64-bit hash that SQL lacks, and classifier and PartEnum stages have no SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
