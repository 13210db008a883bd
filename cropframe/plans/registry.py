"""Query registry: name -> Spark builder (spark, sf_dir) -> DataFrame, plus its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cropframe.schema import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None, digits: int | None = 6):
    """Register a query; results are rounded to ``digits`` so both engines compare equal."""

    def deco(fn: QueryFn) -> QueryFn:
        if digits is None:
            QUERIES[name] = fn
        else:
            def wrapped(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
                return round_doubles(_fn(spark, sf_dir), digits)
            wrapped.__name__ = fn.__name__
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        SURVEY_IDS[name] = ids
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
