"""Tables of sheets under headers of one or two rows, alone or side by side, found by windows over rows and cells.

A sheet's cells are a coordinate list and stay one: bands of rows, headers, clusters of columns and data rows are windows
and joins by sheet, row and column, so a large sheet is many tasks' work. What follows a table in
its band without an empty row between is looked at in another round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.lineage import cut

# Cells of a header, columns between group headers, columns a header may reach over its groups, marks that begin a section.
LEAST, GAP, REACH, LOOK_LEFT = 3, 2, 6, 2
SECTION = r"^(▶|[①②③④⑤⑥⑦⑧⑨⑩]|\(\d+\))"


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides: files of regular sheets are so small for their rows that Spark would send either side whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def placed(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, row, col, value, last, own): filled cells with the last column they reach; places of a merged range have its value and aren't their own.

    ``cells``: sheet, row, col, value; ``merges``: sheet, min_row, min_col, max_row, max_col. Null and blank values are no cells. Of a
    place that comes twice the least value counts, of ranges that begin in one place the largest.
    """
    text = F.trim("value", F.lit(" \t\r\n"))
    own = cells.where(text != "").groupBy("sheet", "row", "col").agg(F.min(text).alias("value"))
    spans = merges.groupBy("sheet", F.col("min_row").alias("row"), F.col("min_col").alias("col")).agg(F.max(F.struct("max_row", "max_col")).alias("to"))
    tops = _met(own, spans, ["sheet", "row", "col"], "left")
    first = tops.select("sheet", "row", "col", "value", F.coalesce("to.max_col", "col").alias("last"), F.lit(True).alias("own"))
    inside = tops.where("to is not null").select("sheet", F.col("row").alias("top"), F.col("col").alias("left"), "value", "to").withColumn("row", F.explode(F.sequence("top", "to.max_row")))
    inside = inside.withColumn("col", F.explode(F.sequence("left", "to.max_col"))).where("row > top or col > left")
    inside = inside.groupBy("sheet", "row", "col").agg(F.min("value").alias("value"))
    rest = _met(inside, own.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti")
    return first.unionByName(rest.select("sheet", "row", "col", "value", F.col("col").alias("last"), F.lit(False).alias("own")))


def _one_round(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, their data cells, where each band goes on) of the first header in each band of ``cells`` (with band)."""
    band = ["sheet", "band"]
    own = cells.where("own")
    rows = own.groupBy(*band, "row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("min"), F.max("last").alias("reach"), F.array_sort(F.collect_list(F.struct("col", "value", "last"))).alias("cells"))
    first = rows.where(F.col("n") >= LEAST).groupBy(*band).agg(F.min("row").alias("row"))
    head = _met(rows, first, [*band, "row"])
    pairs = F.transform(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: F.element_at("cells", i + 1)["col"] - F.element_at("cells", i)["col"])
    sparse = F.exists(pairs, lambda gap: gap > GAP) | F.exists("cells", lambda c: c["last"] > c["col"])
    after = rows.select(*band, (F.col("row") - 1).alias("row"), F.col("cells").alias("next_cells"))
    before = rows.select("sheet", F.col("band").alias("band"), (F.col("row") + 1).alias("row"), F.col("cells").alias("above"))
    within = F.filter(F.coalesce("next_cells", F.array()), lambda c: (c["col"] >= F.col("min")) & (c["col"] <= F.col("reach") + REACH))
    head = _met(_met(head, after, [*band, "row"], "left"), before, [*band, "row"], "left").withColumn("within", within)
    grouped = sparse & (F.size("within") > F.col("n"))
    head = head.select(
        *band, F.col("row").alias("start"), (F.col("row") + grouped.cast("int")).alias("head"), F.when(grouped, F.col("cells")).alias("groups"), "above", F.when(grouped, F.col("within")).otherwise(F.col("cells")).alias("columns"),
    )
    head = cut(head, "heads")  # all that follows starts from it
    # clusters of columns: a column begins one if it is further than the next from all that earlier ones reach
    columns = head.select(*band, "start", F.explode("columns").alias("c")).select(*band, "start", "c.*")
    w = W.partitionBy(*band, "start").orderBy("col")
    apart = F.col("col") - F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)) > 1
    columns = columns.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("cluster", F.sum("apart").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    clusters = columns.groupBy(*band, "cluster").agg(F.min("col").alias("low"), F.max("col").alias("high"), F.count(F.lit(1)).alias("size"))
    shape = clusters.groupBy(*band).agg(F.count(F.lit(1)).alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"))
    shape = shape.select(*band, "clusters", ((F.col("clusters") > 1) & (F.col("least") >= LEAST) & (F.col("most") - F.col("least") <= 1)).alias("parallel"))
    head = _met(head, shape, band)
    # labels over parallel clusters: the group headers, else the row above if it has about one cell a cluster
    told = F.coalesce("groups", F.when(F.size("above") <= F.col("clusters") + 1, F.col("above")))
    labels = head.where("parallel").select(*band, "clusters", F.col("groups").isNotNull().alias("sure"), F.explode(told).alias("g"))
    labels = _met(labels, clusters, band)
    labels = labels.where((F.col("g.col") >= F.col("low") - LOOK_LEFT) & (F.col("g.col") <= F.col("high")))
    nearest = labels.groupBy(*band, "clusters", "sure", "g").agg(F.min(F.struct(F.abs(F.col("g.col") - F.col("low")), "cluster")).alias("to"))
    labels = nearest.groupBy(*band, "clusters", "sure", F.col("to.cluster").alias("cluster")).agg(F.max_by("g.value", "g.col").alias("label"))
    enough = F.count(F.lit(1)).over(W.partitionBy(*band)) >= F.col("clusters") - 1
    labels = labels.withColumn("enough", enough).where("sure or enough").select(*band, "cluster", "label")

    # data: rows under the header until one that has nothing in its columns or begins a section left of them
    under = _met(cells, head.select(*band, "head", F.array_min(F.transform("columns", lambda c: c["col"])).alias("left")), band).where("row > head")
    under = cut(_met(under, columns.select(*band, "col", "cluster"), [*band, "col"], "left"), "under")
    marks = F.col("own") & (F.col("col") < F.col("left")) & F.col("value").rlike(SECTION)
    first_own = F.min(F.when(F.col("own"), F.col("col"))).over(W.partitionBy(*band, "row"))
    state = under.withColumn("marks", marks & (F.col("col") == first_own)).groupBy(*band, "row").agg(F.max(F.col("cluster").isNotNull()).alias("some"), F.max(F.col("cluster").isNotNull() & F.col("own")).alias("fresh"), F.max("marks").alias("section"))
    ends = state.where("not some or section").groupBy(*band).agg(F.min("row").alias("end"))
    # an empty row's number is in no band, so rows of a band have no gap
    state = _met(state, ends, band, "left").where("end is null or row < end")
    kept = state.where("fresh").select(*band, "row")
    data = _met(under.where("cluster is not null"), kept, [*band, "row"]).select(*band, "row", "col", "cluster", "value")
    filled = kept.groupBy(*band).agg(F.count(F.lit(1)).alias("rows"))
    head = _met(_met(head, filled, band, "left"), ends, band, "left")
    goes_on = head.select(*band, F.when(F.col("rows").isNotNull() | F.col("parallel"), F.col("end")).otherwise(F.col("start") + 1).alias("from")).where("`from` is not null")
    tables = head.where("rows is not null or parallel").select(*band, "start", "head", "parallel", F.when(~F.col("parallel"), F.transform("groups", lambda g: g["value"])).alias("groups"))
    parts = _met(_met(columns, tables, [*band, "start"]), labels, [*band, "cluster"], "left")
    of = F.when(F.col("parallel"), F.col("cluster")).otherwise(0)
    parts = parts.select("sheet", "band", "start", of.alias("part"), "parallel", "groups", F.when(F.col("parallel"), F.regexp_replace("label", r"^[* ]+", "")).alias("label"), "col", F.col("value").alias("name"))
    cells_of = _met(data, tables.select(*band, "start", "parallel"), band).select("sheet", "start", of.alias("part"), "row", "col", "value")
    return parts, cells_of, goes_on


def headed_tables(cells: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns and data of all tables: (sheet, start, part, parallel, groups, label, col, name) and (sheet, start, part, row, col, value).

    A band is a stretch of rows without an empty one. Its first row of three cells or more heads a table; if that row has gaps or merged
    cells and the next one has more cells in its reach, it is a row of group headers and the next one is the header. Columns
    further apart than the next form clusters; two clusters or more of three columns or more, of which none has two more than another, are parallel
    tables, labelled by the nearest group header or, if nearly all have one, by the cells above. Data go down
    to a row that has nothing in the header's columns or begins a section to their left; a row that only repeats merged cells
    isn't one. A header without data heads no table. ``start`` is the table's first row, ``part`` its place among parallel ones; a column of a data row without
    value has no row here, nor has a part's data row without any.
    """
    all_cells = cut(placed(cells, merges), "placed")
    rows = all_cells.select("sheet", "row").distinct()
    rows = rows.withColumn("band", F.col("row") - F.row_number().over(W.partitionBy("sheet").orderBy("row")))
    left = cut(_met(all_cells, rows, ["sheet", "row"]), "cells")
    parts = data = None
    while left is not None:
        some, its, goes_on = (cut(df, "tables") for df in _one_round(left))
        parts, data = (new if old is None else old.unionByName(new) for old, new in ((parts, some), (data, its)))
        again = _met(left, goes_on, ["sheet", "band"]).where(F.col("row") >= F.col("from")).drop("from")
        left = cut(again, "cells") if goes_on.limit(1).count() else None
    return parts.drop("band"), data


def markdown_rows(parts: DataFrame, data: DataFrame) -> DataFrame:
    """(sheet, start, part, label, row, line): header (row null), rule (row 0) and data rows of each table, as Markdown."""
    key = ["sheet", "start", "part"]
    clean = lambda c: F.left(F.replace(F.replace(c, F.lit("\n"), F.lit(" / ")), F.lit("|"), F.lit("∣")), F.lit(200))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    heads = parts.groupBy(*key).agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("col", "name"))).alias("columns"))
    names = F.transform("columns", lambda c: c["name"])
    values = _met(data.groupBy(*key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("values")), heads, key)
    body = values.select(*key, "label", "row", line(F.transform("columns", lambda c: clean(F.coalesce(F.try_element_at("values", c["col"]), F.lit(""))))).alias("line"))
    head = heads.select(*key, "label", F.lit(None).cast("int").alias("row"), line(names).alias("line"))
    rule = heads.select(*key, "label", F.lit(0).alias("row"), line(F.transform("columns", lambda c: F.lit("---"))).alias("line"))
    return head.unionByName(rule).unionByName(body)
