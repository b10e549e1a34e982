"""Every query of the library, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Adds a query (spark, sf_dir) -> DataFrame to the catalog."""

    def add(f: Callable) -> Callable:
        if name in _queries:
            raise ValueError(f"two queries are called {name}")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def load() -> None:
    """Imports the modules that register queries."""
    from quillon.plans import features, monitor, policy, risk, streams, tables  # noqa: F401


load()
