"""A corpus run end to end: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import minhash_dedup, packing, quality, secret_scan
from weftlink.llm.common import fresh, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows stay as they are otherwise."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    kept = quality.quality_score(docs, model, score).where(F.col(score) >= quality.QualityParams().threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id.

    Rows are judged by their texts, so rows that repeat an id with another text stay, as do all empty or null texts; rows
    without an id are judged like others and come last. Long texts are compared whole.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs, secret_scan.default_forest())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.pack(docs, packing.PackParams(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the second can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
