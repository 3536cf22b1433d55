"""Keeps queries and their SQL together by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function of a reader (name -> DataFrame) under its own name, with the SQL that gives the same rows."""

        def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return keep
