"""Registered queries: one per operator of the inventory, each with its SQL oracle.

`QUERIES[name](spark, sf_dir) -> DataFrame` runs the package operator over the
canonical relations of `sf_dir`; `ORACLE[name]` is an independent SQL statement
over the driver's tables (DuckDB dialect) that must return the same rows.
Every query reads whole tables; a LIMIT appears only where top-k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_relations

MODULES = ["marts_q", "rules_q", "kpis_q", "plans_q", "search_q", "streaming_q", "blend_q", "evidence_q", "facts_q", "more_q", "builders_q"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_relations(sql, extra)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules fills QUERIES / ORACLE.
    import importlib
    for mod in MODULES:
        importlib.import_module(f"opsledger.catalog.{mod}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
