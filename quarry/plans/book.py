"""The book of registered queries: each a function of (spark, sf_dir), with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables(dict):
    """The driver's tables, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in NAMES

    def all(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in NAMES}


def query(sql: str | None = None):
    """Registers a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
