"""Registry of queries: each has a Spark form and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(value) -> Column:
    """Six decimals, with a plain zero for what rounds to it (sums differ in order)."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6))


def q6(expr: str) -> str:
    return f"(CASE WHEN abs({expr}) < 5e-7 THEN 0.0 ELSE round({expr}, 6) END)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def flat(df: DataFrame, *arrays: str) -> DataFrame:
    """Array columns as text, so that any engine can compare them."""
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in arrays})
