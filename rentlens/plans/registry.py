"""Registry of named query plans and their DuckDB oracle SQL.

Each plan is ``fn(spark, sf_dir) -> DataFrame`` over the test tables (or
projections Spark derives from them). The oracle is an independent SQL
statement over the same tables whose result must equal the plan's.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def load_all() -> None:
    from rentlens.plans import (q_text, q_ingest, q_pricing, q_extract, q_reports,  # noqa: F401
                                q_history, q_benchmark, q_geo, q_sources, q_model, q_stream)
