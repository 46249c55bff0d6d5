"""Registry of the catalogue queries and their reference SQL.

Query modules register with ``query(name, sql)``; SQL is None where it can't express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


from babelshelf.plans import cataloguing, devices, libraries, predictions, scalars  # noqa: E402, F401
