"""Source/sink queries: CSV round trip and row counts of present/missing files."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.files import read_csv, write_csv
from ..sources.registry import count_or_zero
from . import query
from .common import tbl

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def csv_copy(spark, sf):
    path = scratch_path(spark, "docs_csv")
    d = tbl(spark, sf, "documents")
    write_csv(d.filter(F.col("lang").eqNullSafe("en")), path, "overwrite")      # sink created
    write_csv(d.filter(~F.col("lang").eqNullSafe("en")), path, "append")         # then appended
    return path


@query("scan_csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_roundtrip_q(spark, sf):
    return read_csv(spark, csv_copy(spark, sf), DOC_SCHEMA)


@query("scan_count_or_zero", "SELECT 'written' AS path, count(*) AS n FROM documents UNION ALL SELECT 'missing', 0")
def scan_count_or_zero_q(spark, sf):
    path = csv_copy(spark, sf)
    rows = [("written", count_or_zero(spark, path, "csv")),
            ("missing", count_or_zero(spark, path + "-missing", "csv"))]
    return spark.createDataFrame(rows, "path string, n long")
