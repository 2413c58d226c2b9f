"""Names in all cells of all sheets or tables, with where they stand.

Sheets come as one coordinate list, typed tables are unpivoted; both become rows of one shape (file, sheet, header, key, cell), so
hundreds of tables are one scan. The first places of a token are cut to their number in each task before they
are shuffled, and counts are added up there, so a token that stands in a third of all cells is as cheap as any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X

# Kinds of places in the order in which they are gone through, and words that name nothing.
KINDS = ("filename", "sheet", "header", "domain-meta", "kv-key", "cell")
STOP_WORDS = (
    "TRUE", "FALSE", "NULL", "NONE", "YES", "NO", "AND", "OR", "NOT", "START", "END", "BEGIN", "STOP", "MIN", "MAX", "AVG", "SUM", "COUNT",
    "TD", "TR", "TH", "BR", "BM", "LR", "UL", "OL", "LI", "OOXML", "PDF", "PPT", "DOC", "ID", "UI", "UX", "FX", "OK", "IO",
    "PK", "PK_", "NPC", "PC", "PVP", "PVE", "DPS", "HP", "MP", "EXP", "SP", "AP",
)
LEAST, SHORT_CAPITALS = 4, 5
FIELDS = ("kind", "file", "sheet", "header", "key", "row", "col", "cell")


def _meaningful(name):
    capitals = (F.length(name) <= SHORT_CAPITALS) & ~F.contains(name, F.lit("_")) & (F.upper(name) == name) & (F.lower(name) != name)
    return (F.length(name) >= LEAST) & ~name.isin(*STOP_WORDS) & ~capitals


def cells_of_sheets(cells: DataFrame) -> DataFrame:
    """Cells (``FIELDS``) of a coordinate list (file, sheet, row, col, value), with the header of their column and the key of their row.

    Row 1 holds headers, row 2 says what columns are, column 1 holds keys. Numbers are no text; null values and rows or columns before the first are left out.
    """
    rows = cells.where("value is not null and row >= 1 and col >= 1").select("file", "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").alias("cell"))
    # header and key come with the cells of their column and row: no join, and no key that a hot sheet fills
    by_column = W.partitionBy("file", "sheet", "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    by_row = W.partitionBy("file", "sheet", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    first = lambda at, by: F.first(F.when(F.col(at) == 1, F.col("cell")), ignorenulls=True).over(by)
    rows = rows.withColumn("header", first("row", by_column)).withColumn("key", first("col", by_row))
    kind = F.when(F.col("row") == 1, "header").when(F.col("row") == 2, "domain-meta").when(F.col("col") == 1, "kv-key").otherwise("cell")
    return rows.select(kind.alias("kind"), *FIELDS[1:])


def cells_of_tables(tables: dict[str, DataFrame], file: str = "") -> DataFrame:
    """Cells (``FIELDS``) of typed tables: names of all columns, and values of those that hold text; the first column is the key.

    Rows of a table have no numbers and go by their keys. A table is one branch of one plan.
    """
    parts = []
    for name, table in tables.items():
        kinds = dict(table.dtypes)
        text = [(i + 1, c) for i, c in enumerate(table.columns) if kinds[c] == "string"]
        key = F.col(f"`{table.columns[0]}`").cast("string")
        cell = lambda i, c: F.struct(F.lit("kv-key" if i == 1 else "cell").alias("kind"), F.lit(c).alias("header"), F.lit(i).alias("col"), F.col(f"`{c}`").alias("cell"))
        if text:
            own = table.select(key.alias("key"), F.explode(F.array(*[cell(i, c) for i, c in text])).alias("c")).select("key", "c.*").where("cell is not null")
            parts.append(own.select("kind", F.lit(file).alias("file"), F.lit(name).alias("sheet"), "header", "key", F.lit(None).cast("long").alias("row"), "col", "cell"))
        heads = F.array(*[F.struct(F.lit(c).alias("header"), F.lit(i + 1).alias("col")) for i, c in enumerate(table.columns)])
        head = table.sparkSession.range(1).select(F.inline(heads))
        parts.append(head.select(F.lit("header").alias("kind"), F.lit(file).alias("file"), F.lit(name).alias("sheet"), "header", F.lit(None).cast("string").alias("key"), F.lit(1).cast("long").alias("row"), "col", F.col("header").alias("cell")))
    return reduce(DataFrame.unionByName, parts)


def sheets_of_tables(tables: dict[str, DataFrame], file: str = "") -> DataFrame:
    """(file, sheet) of the cells of ``cells_of_tables``, without reading them: each table has the names of its columns as cells."""
    named = F.array(*[F.struct(F.lit(file).alias("file"), F.lit(name).alias("sheet")) for name in tables])
    return next(iter(tables.values())).sparkSession.range(1).select(F.inline(named))


def places(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(token, FIELDS): each name once for each cell it stands in, and names of files and sheets as a whole if they name something.

    A file or sheet without cells isn't known. Repeated cells are places each. ``sheets``: the (file, sheet) of all cells, where they are known
    otherwise (``sheets_of_tables``); without it cells are gone through once more for them.
    """
    # a form is looked for only in cells that hold what it can't do without
    form = lambda has, pattern: F.when(has, F.regexp_extract_all("cell", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    joined, humped = F.contains("cell", F.lit("_")), F.rlike("cell", F.lit("[a-z][A-Z]"))
    names = F.array_distinct(F.concat(form(joined, X.JOINED), form(humped, X.CAMEL), form(joined, X.UPPER)))
    found = cells.select(F.explode(names).alias("token"), *FIELDS).where(_meaningful(F.col("token")))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rest = [none("header", "string"), none("key", "string"), none("row", "long"), none("col", "int")]
    title = lambda kind, sheet, name: F.struct(F.col(name).alias("token"), F.lit(kind).alias("kind"), "file", sheet.alias("sheet"), *rest, F.col(name).alias("cell"))
    sheets = (cells if sheets is None else sheets).select("file", "sheet").distinct()
    titles = sheets.select(F.inline(F.array(title("filename", F.lit(""), "file"), title("sheet", F.col("sheet"), "sheet")))).distinct().where(_meaningful(F.col("token")))
    return titles.unionByName(found)


def index(places: DataFrame, n: int = 3) -> DataFrame:
    """(token, count, kinds, first): in how many places each token stands, of which kinds, and its first ``n`` places.

    Places go by file, sheet, kind as gone through, row, key and column.
    """
    kind_rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = ["file", "sheet", kind_rank, "row", "key", "col", "cell"]
    # rows are ordered by a number first: many tokens begin alike, and comparing them is slow
    places = places.withColumn("hash ", F.xxhash64("token"))
    # counted by token and kind in fixed width first, so that cells make no set for each token
    counts = places.groupBy("hash ", "token", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("hash ", "token").agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    # row_number with a bound is cut in each task before rows move; what is left is in order, so the first place takes those after it along
    by = W.partitionBy("hash ", "token").orderBy(*order)
    first = places.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    first = first.withColumn("first", F.collect_list(F.struct(*FIELDS)).over(by.rowsBetween(0, max(n - 1, 0)))).where(F.col("place") == 1)
    return counts.join(first.select("hash ", "token", "first"), ["hash ", "token"]).drop("hash ")


def tokens_by_kind(places: DataFrame) -> DataFrame:
    """(kind, tokens, places): how many distinct tokens stand in each kind of place, and how often."""
    return places.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("places"))
