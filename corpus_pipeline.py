"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input.

1. quality classifier: documents that score below the threshold go;
2. line dedup: repeated and near-repeated lines go, the first one stays;
3. SimHash near-dedup: one document of each group stays;
4. secret scans: secrets are masked in the texts;
5. packing: what is left is packed into token sequences.

Every stage but the last returns the columns of its input. Repeated rows, NULLs,
empty texts and empty tables are handled as the operators' docstrings say.
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from ulasan.llm import common, line_dedup, packing, quality, secret_scan, simhash  # noqa: E402
from ulasan.session import materialize  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    _, model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return line_dedup.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return simhash.one_of_each_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing_stage),
]

#: No SQL: classifier, MinHash lines and packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
