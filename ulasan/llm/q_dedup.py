"""Queries on duplicates and likeness."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .fingerprint import edited_pairs, hex_string, likeness
from .line_dedup import dedup_lines
from .registry import query
from .simhash import simhash_groups
from .substring_dedup import remove_repeats


@query("op7_simhash")
def op7(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_document_fingerprint")
def op6(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex_string(F.col("fp")).alias("fingerprint"),
        hex_string(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


@query("op2_line_dedup")
def op2(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated and near-repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_suffix_array_dedup")
def op3(spark, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings of earlier documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
