"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def quoted(words: Iterable[str]) -> str:
    """A SQL list of string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def mapped(pairs: dict[str, float]) -> str:
    """SQL rows of (word, value)."""
    return ", ".join(f"('{w}', {v})" for w, v in pairs.items())
