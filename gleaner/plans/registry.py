"""The registered queries of the documentation operators, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from gleaner.plans import code_queries, doc_queries, file_queries, source_queries  # noqa: E402, F401  (they register themselves)
