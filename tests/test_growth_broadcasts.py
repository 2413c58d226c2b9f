"""Queries, steps and chunks of search plans are shuffled by joins, however small their files are."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import searching
from quarry.plans.book import Tables
from quarry.search import executor
from quarry.search.retrieval import structural_each


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast(text: str) -> list[str]:
    """What stands under each broadcast of a plan."""
    lines, at = text.splitlines(), lambda line: len(line) - len(line.lstrip(" :+-|"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if at(lines[j]) <= at(line)), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that are cut on the way."""
    found = []

    def noted(df, name):
        found.append(plan(df))
        return cut(df, name)

    cut = executor.cut
    for module in (executor, searching):
        monkeypatch.setattr(module, "cut", noted, raising=False)
    return found


def test_no_query_step_or_chunk_is_broadcast(spark, sf_dir, plans):
    tables = searching.plan_tables(Tables(spark, sf_dir))
    plans += map(plan, tables)
    queries, steps, chunks, aliases, edges, answers = tables
    plans.append(plan(executor.run_plans(queries, steps, chunks, aliases, edges, executor.by_aliases(chunks, aliases), answers)))
    sent = [x for p in plans for x in broadcast(p)]
    assert len(plans) >= 10
    assert [x for x in sent if any(c in x for c in ("query_id", "orderkey"))] == []
    assert [x for x in sent if "HashAggregate(keys=" not in x.split("FileScan")[0]] == []  # distinct names may be


def test_pairs_of_one_workbook_are_dealt(spark):
    chunks = spark.range(5).select(F.col("id").cast("string").alias("id"), (F.col("id") % 1).cast("string").alias("workbook"), F.lit("Sheet: a").alias("sheet"), F.lit("s").alias("section_path"), F.concat(F.lit("word"), "id").alias("text"))
    asked = spark.range(3000).select((F.col("id") % 1).cast("string").alias("workbook"), F.concat(F.lit("word"), F.col("id") % 5, F.lit(" n"), "id").alias("query"))
    found = structural_each(asked, chunks, 2)
    assert found.count() == 6000
    first = {(r["query"].split()[0], r["id"]) for r in found.where("place = 1").select("query", "id").distinct().collect()}
    assert first == {(f"word{i}", str(i)) for i in range(5)}
    assert found.groupBy(F.spark_partition_id()).count().count() > 1
