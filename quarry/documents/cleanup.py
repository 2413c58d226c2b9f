"""Cleanup of converted documents: what was said twice goes, what was cut is joined.

Section frames: doc_id, pos, level, title, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X

# Marks that a conversion leaves in a heading.
CONTINUED = r"\s*\((?:계속|이어서|continued|cont\.)\)\s*$"
CONTINUED_HEADING = r"(?m)^(#{1,6}[ \t].*?)[ \t]*\((?:계속|이어서|continued|cont\.)\)[ \t]*$"
TILE = r"(?m)^#{1,6}\s*(?:타일|섹션|Tile|Section)\s*\d+(?:\s*[/-]\s*\d+)?\s*$\n?"
ANALYSIS = r"(?m)^(?:>\s*)?(?:분석 단계|분석 메모|Analysis (?:step|note))\b.*$\n?"


def without_marks(text: Column, continued: bool = True) -> Column:
    """Without tile and analysis headings, headings' marks of continuation (unless ``continued`` says that they are still needed), and more than two blank lines."""
    out = F.regexp_replace(F.regexp_replace(text, TILE, ""), ANALYSIS, "")
    out = F.regexp_replace(out, CONTINUED_HEADING, "$1") if continued else out
    return F.regexp_replace(out, r"\n{4,}", "\n\n\n")


def section_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, level, title, body) of every heading with the text below it, up to the next heading."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=#{1,6} )")
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(parts).alias("pos", "part"))
    head = F.regexp_extract("part", r"\A(#{1,6}) ", 1)
    rows = rows.select(id_col, "pos", F.length(head).alias("level"), F.when(head != "", F.trim(F.regexp_extract("part", r"\A#{1,6} ([^\n]*)", 1))).otherwise("").alias("title"), F.when(head != "", F.regexp_replace("part", r"\A#{1,6} [^\n]*\n?", "")).otherwise(F.col("part")).alias("body"))
    return rows.withColumn("body", F.trim("body", F.lit(" \n\t\r"))).where("level > 0 or body <> ''")


def rendered(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the sections of each document in order as Markdown."""
    line = F.concat(F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))).otherwise(""), F.when((F.col("level") > 0) & (F.col("body") != ""), F.lit("\n")).otherwise(""), F.col("body"))
    return sections.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def _kept(sections: DataFrame, place: Column) -> DataFrame:
    return sections.withColumn("place ", place).where("`place ` = 1").drop("place ")


def without_repeats(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of sections of one document with the same level and title the longest; of equally long ones the later."""
    order = [F.desc(F.length("body")), F.desc("pos")]
    bare = X.without_number(F.lower(F.regexp_replace("title", CONTINUED, "")))
    keyed = sections.withColumn("key ", F.when(F.col("level") > 0, bare).otherwise(F.concat(F.lit("\n"), F.col("pos").cast("string"))))
    return _kept(keyed, F.row_number().over(W.partitionBy(id_col, "level", "key ").orderBy(*order))).drop("key ")


def without_cross_level_repeats(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of sections of one title and the same body at several levels, the highest; then the first."""
    keyed = sections.withColumn("key ", X.deep_form(F.col("body")))
    keyed = keyed.withColumn("key ", F.when((F.col("key ") == "") | (F.col("level") == 0), F.concat(F.lit("\n"), F.col("pos").cast("string"))).otherwise(F.sha2("key ", 256)))
    return _kept(keyed, F.row_number().over(W.partitionBy(id_col, F.lower("title"), "key ").orderBy("level", "pos"))).drop("key ")


def without_twin_neighbours(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of neighbouring sections of one level with the same body the later."""
    w = W.partitionBy(id_col).orderBy("pos")
    form = X.deep_form(F.col("body"))
    twin = (F.lead("level").over(w) == F.col("level")) & (F.lead(form).over(w) == form) & (form != "")
    return sections.withColumn("twin ", F.coalesce(twin, F.lit(False))).where("not `twin `").drop("twin ")


def without_repeated_headings(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """An empty section whose heading is repeated by the next one, or a container named again later, goes."""
    w = W.partitionBy(id_col).orderBy("pos")
    again = (F.col("body") == "") & (F.lower(F.lead("title").over(w)) == F.lower("title"))
    empty = (F.col("body") == "") & (F.coalesce(F.lead("level").over(w), F.lit(0)) > F.col("level"))
    named = F.row_number().over(W.partitionBy(id_col, "level", F.lower("title")).orderBy("pos"))
    rows = sections.withColumns({"again ": F.coalesce(again, F.lit(False)), "empty ": empty, "named ": named})
    return rows.where("not `again ` and not (`empty ` and `named ` > 1 and level > 0)").drop("again ", "empty ", "named ")


def without_lone_headings(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Headings with nothing below go, unless a deeper one follows."""
    following = F.coalesce(F.lead("level").over(W.partitionBy(id_col).orderBy("pos")), F.lit(0))
    return sections.withColumn("next ", following).where("body <> '' or `next ` > level").drop("next ")


def without_stubs(sections: DataFrame, id_col: str = "doc_id", lines: int = 5) -> DataFrame:
    """The first section of a document goes if it has fewer lines than ``lines`` and a later section of its title goes on with its text."""
    same = W.partitionBy(id_col, F.lower("title")).orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    later = F.max(F.length("body")).over(same)
    first = F.min("pos").over(W.partitionBy(id_col))
    short = F.size(F.split("body", "\n")) < lines
    rows = sections.withColumn("stub ", (F.col("pos") == first) & short & (F.coalesce(later, F.lit(0)) > F.length("body")))
    return rows.where("not `stub `").drop("stub ")


def continued(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections that follow one of their title and level, or of their title if marked as a continuation, are joined to it; marks go."""
    w = W.partitionBy(id_col).orderBy("pos")
    bare = F.regexp_replace("title", CONTINUED, "")
    again = (F.col("level") > 0) & (F.lag("level").over(w) == F.col("level")) | F.col("title").rlike(CONTINUED)
    goes_on = again & (F.regexp_replace(F.lag("title").over(w), CONTINUED, "") == bare)
    rows = sections.withColumn("bare ", bare).withColumn("run ", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"] != ""), lambda x: x["body"]), "\n\n")
    return rows.groupBy(id_col, "run ").agg(F.min("pos").alias("pos"), F.min_by("level", "pos").alias("level"), F.min_by("bare ", "pos").alias("title"), body.alias("body")).drop("run ")


def merged_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, cells): rows of tables of one key and header together, each once, in order of first appearance.

    ``tables``: keys, table, row (0 is the header), cells.
    """
    header = F.first(F.when(F.col("row") == 0, F.array_join("cells", "\u0001")), ignorenulls=True).over(W.partitionBy(*keys, "table").orderBy("row"))
    rows = tables.withColumn("header ", header)
    once = rows.withColumn("place ", F.row_number().over(W.partitionBy(*keys, "header ", F.array_join("cells", "\u0001")).orderBy("table", "row"))).where("`place ` = 1")
    first = F.min("table").over(W.partitionBy(*keys, "header "))
    once = once.withColumn("first ", first)
    return once.select(*keys, F.col("first ").alias("table"), (F.row_number().over(W.partitionBy(*keys, "header ").orderBy("table", "row")) - 1).alias("row"), "cells")


def first_annotations(lines: DataFrame, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Of lines that a pattern's first group names alike the first of each document; other lines stay."""
    key = F.regexp_extract("line", pattern, 1)
    rows = lines.withColumn("key ", F.when(key != "", F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("p"), F.col("pos").cast("string"))))
    return rows.withColumn("place ", F.row_number().over(W.partitionBy(id_col, "key ").orderBy("pos"))).where("`place ` = 1").drop("key ", "place ")


def without_bold_twins(lines: DataFrame, id_col: str = "doc_id", back: int = 200) -> DataFrame:
    """Lines of bold text alone go where a heading of that text stands within so many lines before."""
    bold = F.regexp_extract("line", r"^\s*\*\*([^*]+)\*\*:?\s*$", 1)
    title = F.regexp_extract("line", r"^#{1,6} +(.*?)\s*$", 1)
    rows = lines.withColumns({"key ": F.lower(F.trim(F.when(title != "", title).otherwise(bold))), "head ": title != ""})
    seen = F.max(F.when(F.col("head "), F.col("pos"))).over(W.partitionBy(id_col, "key ").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    twin = ~F.col("head ") & (F.col("key ") != "") & (F.col("pos") - seen <= back)
    return rows.withColumn("twin ", F.coalesce(twin, F.lit(False))).where("not `twin `").drop("key ", "head ", "twin ")


def quotes_found(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, quotes, found, percent, mark): how many quotes stand in their target's text, blanks aside; ok from 80 %, weak from 40."""
    both = quotes.join(texts, key, "left")
    hit = F.coalesce(X.quoted_form(F.col("text")).contains(X.quoted_form(F.col("quote"))), F.lit(False))
    out = both.groupBy(key).agg(F.count(F.lit(1)).alias("quotes"), F.count_if(hit).alias("found")).withColumn("percent", F.bround(F.col("found") * 100.0 / F.col("quotes"), 1))
    return out.withColumn("mark", F.when(F.col("percent") >= 80, "ok").when(F.col("percent") >= 40, "weak").otherwise("bad"))
