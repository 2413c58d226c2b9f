"""Equal chunks and equal plans are gone through once."""

from pyspark.sql import functions as F

from quarry.search.executor import ARGUMENTS, _alike
from quarry.search.retrieval import structural_each


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_chunks_are_scored_once(spark):
    chunks = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("workbook"), F.lit("Sheet: a").alias("sheet"), F.lit("s").alias("section_path"), F.when(F.col("id") < 490, "red").otherwise("red blue").alias("text"))
    found = structural_each(spark.createDataFrame([("w", "red blue")], "workbook string, query string"), chunks, 15)
    best = [str(i) for i in range(490, 500)] + sorted(str(i) for i in range(490))[:5]
    assert [(r.place, r.id) for r in found.orderBy("place").collect()] == list(enumerate(best, 1))
    assert plan(found).index("collect_list(") > plan(found).index("Join")  # classes are made below the join of queries


def test_equal_plans_have_one_head(spark):
    queries = spark.createDataFrame([(i, "q", "fact", ["a", "b", "c", str(i)]) for i in range(4)], "query_id int, query string, query_type string, key_systems array<string>")
    steps = spark.createDataFrame([(i, 0, "query_game_data", (None, None, None, None, "t")) for i in range(3)], f"query_id int, step int, tool string, args {ARGUMENTS}")
    answers = spark.createDataFrame([(1, 0)], "query_id int, step int")
    assert sorted(map(tuple, _alike(queries, steps, answers).collect())) == [(0, 0), (1, 1), (2, 0), (3, 3)]
