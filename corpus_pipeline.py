"""The corpus pipeline: quality classifier, near-duplicate removal, benchmark decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the rows are
written as Parquet and read again. All but the last return the columns of ``documents``; the last returns packed pieces.

Defined results: the stages' own; an empty table goes through as an empty table; extra columns are kept to the last but
one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, near_dedup, packing, quality_classifier, secrets
from tidemark.llm.common import documents, store

STAGES = [
    ("quality_classifier", quality_classifier.stage_quality),
    ("near_dedup", near_dedup.stage_near_dedup),
    ("decontamination", decontamination.stage_decontamination),
    ("secret_scans", secrets.stage_secrets),
    ("packing", packing.stage_packing),
]

#: SQL has no form for the classifier, the sampling and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
