"""Queries by name, each with the SQL that checks it, and the tables that results still read."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventide.sources.work import Written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_owned: list[Callable[[], None]] = []


def own(close: Callable[[], None]) -> None:
    """Call close in close_all(): what it deletes is read by lazy results, which only their user knows to be done."""
    _owned.append(close)


def keep(df: DataFrame) -> DataFrame:
    """Write what several branches of a query read, once; the table stays until close_all()."""
    table = Written(df)
    own(table.drop)
    return table.df


def close_all() -> None:
    """Delete the intermediate tables of all queries so far; their results can't be read any more. Runs at the end of the process too."""
    while _owned:
        try:
            _owned.pop()()
        except Exception:  # noqa: BLE001  the session may have stopped before
            continue


atexit.register(close_all)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module once; returns the two registries."""
    from eventide import plans  # noqa: F401

    return QUERIES, ORACLES
