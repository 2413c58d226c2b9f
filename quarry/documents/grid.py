"""Sheets as coordinate lists: merged cells, tables side by side, tokens with their places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filled(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the value of a merged range's first cell in all of its places that have none.

    ``cells``: sheet, row, col, value; ``merges``: sheet, min_row, min_col, max_row, max_col.
    """
    top = merges.join(cells.select("sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("top")), ["sheet", "min_row", "min_col"])
    inside = top.select("sheet", "top", F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col").select("sheet", "row", "top", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    inside = inside.groupBy("sheet", "row", "col").agg(F.min("top").alias("top"))
    return cells.join(inside, ["sheet", "row", "col"], "full_outer").select("sheet", "row", "col", F.coalesce(F.when(F.col("value") != "", F.col("value")), "top", "value").alias("value"))


def clusters(cells: DataFrame, least: int = 3) -> DataFrame:
    """(sheet, row, cluster, first, last, size): runs of neighbouring filled cells in each row, of ``least`` or more."""
    rows = cells.where("value <> ''")
    w = W.partitionBy("sheet", "row").orderBy("col")
    rows = rows.withColumn("cut", F.coalesce((F.col("col") - F.lag("col").over(w) > 1).cast("int"), F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("sheet", "row", "cluster").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.count(F.lit(1)).alias("size"))
    return out.where(F.col("size") >= least)


def tables(cells: DataFrame, least: int = 3) -> DataFrame:
    """(sheet, table, row, col, value): tables of a sheet, each headed by a row with a run of ``least`` or more filled cells.

    A run heads a table if the row above has none in its columns; the table goes down to the next row without
    any value in those columns. Parallel runs in one row head tables of their own. A sheet is one task's work.
    """

    def find(sheet: pd.DataFrame) -> pd.DataFrame:
        grid: dict[int, dict[int, str]] = {}
        for r in sheet[sheet["value"].fillna("") != ""].itertuples():
            grid.setdefault(r.row, {})[r.col] = r.value
        out, taken, n = [], set(), 0
        for row in sorted(grid):
            cols, runs = sorted(grid[row]), []
            for c in cols:
                if runs and c == runs[-1][-1] + 1:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            for run in runs:
                if len(run) < least or any((row, c) in taken for c in run):
                    continue
                at = row
                while at in grid and any(c in grid[at] for c in run):
                    for i, c in enumerate(run):
                        taken.add((at, c))
                        out.append((sheet["sheet"].iloc[0], n, at - row, i, grid[at].get(c, "")))
                    at += 1
                n += 1
        return pd.DataFrame(out, columns=["sheet", "table", "row", "col", "value"])

    return cells.select("sheet", "row", "col", "value").groupBy("sheet").applyInPandas(find, "sheet string, table int, row int, col int, value string")


def table_lines(tables: DataFrame) -> DataFrame:
    """(sheet, table, row, line): tables as lines of Markdown."""
    value = F.replace(F.replace("value", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda x: x["v"])
    return tables.groupBy("sheet", "table", "row").agg(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


def non_empty(df: DataFrame, show: int = 4) -> DataFrame:
    """The first ``show`` columns that have any text in them."""
    have = df.agg(*[F.max(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "").alias(c) for c in df.columns]).first()
    return df.select([F.col(f"`{c}`") for c in df.columns if have[c]][:show])


def tokens(cells: DataFrame, pattern: str = r"[A-Za-z_][A-Za-z0-9_]{3,}") -> DataFrame:
    """(token, kind, n): in how many places of each kind a token stands; ``cells``: kind, value."""
    return cells.select("kind", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)))).alias("token")).groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))


def key_values(sheet: DataFrame, key: str, value: str, comments: list[str]) -> DataFrame:
    """(key, value, comment): the comment is the first of the columns with Hangul in it."""
    comment = F.coalesce(*[F.when(F.col(c).rlike("[가-힣]"), F.col(c)) for c in comments], F.lit(""))
    return sheet.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "").select(F.trim(F.col(key)).alias("key"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"), comment.alias("comment"))


def index(rows: DataFrame, category: str, workbook: str, sheet: str) -> DataFrame:
    """(category, workbooks, sheets): a two-level index, sorted, with counts."""
    books = rows.groupBy(category, workbook).agg(F.sort_array(F.collect_set(sheet)).alias("sheets"))
    book = F.struct(F.col(workbook).alias("name"), F.size("sheets").alias("n"), F.col("sheets"))
    return books.groupBy(category).agg(F.array_sort(F.collect_list(book)).alias("workbooks"), F.sum(F.size("sheets")).alias("sheets"))
