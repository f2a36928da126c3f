"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.scalars import WHITESPACE
from trailmark.sources.fixtures import Inputs, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(key: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key``; ``@WS`` is the whitespace set."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[key] = with_fixtures(oracle).replace("@WS", "'" + WHITESPACE + "'")
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
