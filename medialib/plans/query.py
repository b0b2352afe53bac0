"""How a query is registered: a function of the views of a scale folder, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import frame, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The tables and views of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable:
    def add(make: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[make.__name__] = with_views(sql)
        return make

    return add
