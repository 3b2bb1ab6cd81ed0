"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from vidtables.jobs import scalar_queries, stateful_queries, table_queries

MODULES: list = [scalar_queries, table_queries, stateful_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
