"""Registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import book, extracts, forms, lookups, machines, pipeline_state, records, searching, tables, texts, wiki  # noqa: F401  (they fill the book)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.QUERIES["change_classification"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(book.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(book.SQL)
