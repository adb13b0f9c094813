"""Query registration and lazy table access."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.session import tune

MODULES = (
    "expression", "relations", "ranges", "files", "scalars", "calls", "statistics", "knowledge", "models",
)


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Suite:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register


def load_all() -> Suite:
    merged = Suite()
    for module in MODULES:
        suite = importlib.import_module(f"helixframe.plans.{module}").suite
        clash = merged.queries.keys() & suite.queries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.queries.update(suite.queries)
        merged.oracle.update(suite.oracle)
    return merged
