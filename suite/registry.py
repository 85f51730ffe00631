"""Registry of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.tables import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = oracle(sql)
        return fn

    return add


def scaled(c, scale: float) -> Column:
    """Rounded to 1/scale as a whole number, the same in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("long")


def s(expr: str, scale: float) -> str:
    """The same as ``scaled`` in SQL text."""
    return f"cast(floor(({expr}) * cast({float(scale)!r} as double) + cast(0.5 as double)) as bigint)"


def lng(expr: str) -> str:
    return f"cast({expr} as bigint)"
