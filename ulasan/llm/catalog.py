"""The queries of this subpackage: ``QUERIES[name](spark, sf_dir)`` and, where
SQL can express one, ``ORACLE[name]`` for DuckDB."""
from __future__ import annotations

from . import q_corpus, q_dedup, q_manifest, q_tokens  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
