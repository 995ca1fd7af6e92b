"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from quakeframe.plans import columns, gridded, incremental, pipelines, relational, scalars  # noqa: F401  they register their queries
from quakeframe.plans.registry import ORACLE, QUERIES

FLAGSHIP = QUERIES["score_table"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
