"""Named queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    query: Query
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked here, its values in tests."""
    def add(query: Query) -> Query:
        if name in CASES:
            raise ValueError(f"duplicate query {name}")
        CASES[name] = Case(query, dedent(sql).strip() if sql else None)
        return query
    return add
