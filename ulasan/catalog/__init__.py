"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame``; ``ORACLE[name] = sql``
(absent when the operator has no SQL form; those get rows-only checks plus
brute-force unit tests).
"""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def prepare(spark) -> None:
    """Session settings the queries rely on: UTC (the oracle is zone-naive)
    and a known checkpoint folder (set only when the session has none)."""
    from ..session import ensure_checkpoint_dir, ship_package
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    from . import corpus_q, collect_q, labels_q, features_q, model_q, io_q, stream_q  # noqa: F401
    return QUERIES, ORACLE
