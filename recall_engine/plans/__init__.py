"""Registered queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from recall_engine.plans import evaluation, log, retrieval, structure, writing

_PARTS = (retrieval, structure, evaluation, log, writing)


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
