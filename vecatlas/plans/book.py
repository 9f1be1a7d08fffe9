"""Registration of queries beside their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecatlas.sources.fixtures import oracle, view


class Tables:
    """Tables and views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self._dir, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of Tables under its name, with DuckDB SQL over the same tables and views."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = oracle(sql)
            return f

        return add
