"""The registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from quern.plans import dialogue, indexes, ingestion, monitoring, orchestration, quality, retrieval, routing, rules, stores, traversal
from quern.plans.registry import Query

MODULES = (retrieval, ingestion, dialogue, monitoring, traversal, routing, stores, quality, rules, indexes, orchestration)


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, run in module.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.Q.sql.items()}
