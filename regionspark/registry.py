"""The registered queries and helpers for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def rounded(c: str | Column, places: int = 6) -> Column:
    return F.round(c, places)


def long_(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
