"""All queries of the engine, by name."""

from __future__ import annotations

from . import queries_evaluation, queries_evidence, queries_generation, queries_retrieval, queries_runs

MODULES = (queries_retrieval, queries_evidence, queries_evaluation, queries_generation, queries_runs)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
