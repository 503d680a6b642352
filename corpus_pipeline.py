"""From raw documents to packed sequences: five stages, each written before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from campanula.llm import bestfit, mixing, quality, secrets, simhash
from campanula.llm.common import shared_folder

#: No SQL: expectation-maximisation, bit-distance components and byte-pair encoding.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose posterior quality is good enough; empty and null texts are rejected by the base rules."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each SimHash component; documents without words share one component."""
    return simhash.keep_one(docs, radius=simhash.RADIUS, shingle=simhash.SHINGLE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in place; null texts stay null and every row stays."""
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each leaf's share by the target weights; a leaf's last document may be cut to its prefix."""
    return mixing.mix(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left; one row per piece, null texts as the closing id alone."""
    return bestfit.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
