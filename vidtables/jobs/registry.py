"""Registering queries: a function of derived tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidtables.sources.fixtures import common_tables, fixture


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def add(self, name: str, tables: str, query: Callable[..., DataFrame], sql: str | None = None) -> None:
        """query takes the named tables in order. sql follows a WITH clause of them; it may go on with ", name AS (...)"."""
        names = tables.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(*[fixture(spark, sf_dir, t) for t in names])

        self.QUERIES[name] = run
        if sql is not None:
            head = common_tables(*names)
            self.ORACLES[name] = f"{head}\n{sql}" if head != "WITH " else sql
