"""Shared inputs of the registered queries: driver tables, source specs, and
the artefact rows that exercise cleaning steps the driver tables never hit."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parallel import spread
from ..sources.registry import SourceSpec
from .sqlgen import values


def tbl(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def test_sources(sf: str, extra_missing: bool = False) -> list[SourceSpec]:
    """The four driver tables standing in for the four raw sources, in the
    reference's priority order (first source wins duplicates)."""
    sf = sf.rstrip("/")
    specs = [
        SourceSpec("documents", f"{sf}/documents.parquet", "text", None, ["doc_id"]),
        SourceSpec("pages", f"{sf}/pages.parquet", "html", None, ["page_id"]),
        SourceSpec("conversations", f"{sf}/conversations.parquet", "text", None, ["conv_id", "turn"]),
        SourceSpec("events", f"{sf}/events.parquet", "props", F.col("ts").cast("string"), ["event_id"]),
    ]
    if extra_missing:
        specs.insert(2, SourceSpec("missing", f"{sf}/no_such_table.parquet", "text", None, ["id"]))
    return specs


SOURCES_SQL = """
    SELECT text, NULL::TIMESTAMP AS date, 'documents' AS source, 0 AS source_rank, doc_id AS k1, 0::BIGINT AS k2 FROM documents
    UNION ALL SELECT html, NULL::TIMESTAMP, 'pages', 1, page_id, 0 FROM pages
    UNION ALL SELECT text, NULL::TIMESTAMP, 'conversations', 2, conv_id, turn FROM conversations
    UNION ALL SELECT props, ts, 'events', 3, event_id, 0 FROM events
"""

# --- fixed values: cleaning artefact rows (input text), from the fixture table ---
ARTEFACTS = [
    "&amp;lt;b&gt; enak sekali",
    "Cek https://t.co/xyz @budi #MBG enak!",
    "Mantap.. Ni..",
    "a - - b",
    "\u201cBagus\u201d sekali\u2026",
    "'ok'",
    "\U0001f44d\U0001f44d mantap program ini",
    "a@b.com kirim ke sini",
    "bagus\nsekali\r\nya",
    "\"\"'dua kata'\"\"",
    "gratis\u2014tapi basi",
    "\u3000 tepi \u2003 kata",
    "halo @budi_é dan @x",
    "www.a.id/x y z",
    "ya a",
    "abc",
    "",
    "\U0001f600",
    "NA",
    "#N/A N/A",
    "  sama persis ",
    "sama persis",
]
# ---------------------------------------------------------------------------


def artefacts(spark: SparkSession) -> DataFrame:
    rows = [(i, t) for i, t in enumerate(ARTEFACTS)] + [(len(ARTEFACTS), None)]
    return spark.createDataFrame(rows, "id long, text string")


def artefacts_sql() -> str:
    rows = [(i, t) for i, t in enumerate(ARTEFACTS)] + [(len(ARTEFACTS), None)]
    return f"(SELECT id::BIGINT AS id, text::VARCHAR AS text FROM {values(rows, ['id', 'text'])})"


def text_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """docs ∪ pages.html ∪ artefact rows as ``(src, id, text)``."""
    return (spread(tbl(spark, sf, "documents")).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
            .unionByName(spread(tbl(spark, sf, "pages")).select(F.lit("pages").alias("src"), F.col("page_id").alias("id"),
                                                        F.col("html").alias("text")))
            .unionByName(artefacts(spark).select(F.lit("artefacts").alias("src"), "id", "text")))


def text_inputs_sql() -> str:
    return f"""(SELECT 'documents' AS src, doc_id AS id, text FROM documents
      UNION ALL SELECT 'pages', page_id, html FROM pages
      UNION ALL SELECT 'artefacts', id, text FROM {artefacts_sql()})"""
