"""Named queries over the given tables, each with its DuckDB oracle SQL where one exists.

Every query reads whole tables (no id subsets, prefixes or row caps). Doubles are
rounded to 6 digits in both the Spark result and the SQL, because the two engines
sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def oracle(name: str) -> str:
    """The SQL of a query that is already registered (a second query with the same result)."""
    return REGISTRY[name][1]


def _load_all() -> None:
    # Importing the modules fills REGISTRY.
    from tidewatch.plans import q_core, q_detect, q_ml, q_profile, q_stream  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
