"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SURVEY_ID: dict[str, str] = {}


def query(name: str, survey_id: str, sql: str | None = None, views: tuple[str, ...] = (),
          extra: dict[str, str] | None = None):
    """Register a query; ``sql`` (with ``views`` as CTEs) is its DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY_ID[name] = survey_id
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, extra=extra)
        return fn
    return deco
