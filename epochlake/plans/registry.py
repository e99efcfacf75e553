"""All queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL of the same result if SQL can state it."""

    def add(f: Query) -> Query:
        if name in _FOUND:
            raise ValueError(f"query {name} is registered twice")
        _FOUND[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from epochlake.plans import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _FOUND.items() if s is not None}
