"""What the driver holds must not grow with the cells of sheets."""

from pyspark.sql import functions as F

from quarry.documents import headed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sheets_are_never_sent_whole(spark):
    cells = spark.createDataFrame([("s", 1, c, f"h{c}") for c in (1, 2, 3)] + [("s", 2, c, "v") for c in (1, 2, 3)], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([], "sheet string, min_row int, min_col int, max_row int, max_col int")
    rows = headed.markdown_rows(*headed.headed_tables(cells, merges))
    assert "Broadcast" not in plan(headed.placed(cells, merges)) and "Broadcast" not in plan(rows)
    assert [r.line for r in rows.orderBy(F.col("row").asc_nulls_first()).collect()] == ["| h1 | h2 | h3 |", "| --- | --- | --- |", "| v | v | v |"]
