"""Registry of runnable queries and the comparison SQL that belongs to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urltriage.plans import fixtures
from urltriage.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_tables(tables: list[str], steps: list[tuple[str, str]], final: str) -> str:
    """SQL text with the derived input tables and named steps in front."""
    parts: list[tuple[str, str]] = []
    for t in tables:
        parts.extend(p for p in fixtures.cte(t) if p not in parts)
    parts.extend(steps)
    if not parts:
        return final
    body = ",\n".join(f"{n} as ({s})" for n, s in parts)
    return f"with {body}\n{final}"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
