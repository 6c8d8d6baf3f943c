"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; the SQL twin is left out only where SQL cannot say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(fn: Query) -> Query:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"query {key} exists")
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return register


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> Registry:
    """Registry with all queries of this package."""
    from checks import catalogs, files, graphs, history, integrity, masks, paging, storage, vendors

    registry = Registry()
    for module in (masks, paging, integrity, catalogs, graphs, history, files, storage, vendors):
        module.register(registry)
    return registry
