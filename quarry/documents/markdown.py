"""Markdown documents as frames of lines, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X

MOST_TOKENS, LEAST_TOKENS = 2000, 100


def front_matter(text: Column) -> Column:
    """``key: value`` lines between the first two rules as a map; empty without them."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(unique)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 2) -> DataFrame:
    """(id, position, heading, text) of the parts between headings of a level; what stands before the first has the title or none as heading. Blank parts go."""
    mark = "#" * level
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), rf"\n(?={mark} )")
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(parts).alias("position", "part"))
    title = rf"(?s)\A\s*{'#' * (level - 1)} ([^\n]*)" if level > 1 else r"\A()"
    heading = F.when(F.col("part").startswith(f"{mark} "), F.regexp_extract("part", rf"\A{mark} ([^\n]*)", 1)).otherwise(F.regexp_extract("part", title, 1))
    body = F.when(F.col("part").startswith(f"{mark} "), F.regexp_replace("part", rf"\A{mark} [^\n]*\n?", "")).otherwise(F.regexp_replace("part", title, ""))
    return rows.select(id_col, "position", F.trim(heading).alias("heading"), F.trim(body, F.lit(" \n\r\t")).alias("text")).where("text <> ''")


def packed(parts: Column, most: int = MOST_TOKENS) -> Column:
    """Neighbouring strings joined as long as they have at most ``most`` tokens together; a longer one stands alone."""
    size = X.estimated_tokens
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, part):
        both = F.concat(acc["open"], F.lit("\n\n"), part)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), part.alias("open")))
            .when(size(both) <= most, F.struct(acc["done"].alias("done"), both.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), part.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x != ""))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOKENS, least: int = LEAST_TOKENS, keep_small: bool = False) -> DataFrame:
    """(id, chunk, heading, text, tokens, has_table, has_mermaid, has_images): sections, long ones split at third-level headings and packed.

    Chunks under ``least`` tokens go if their document has a longer one (unless ``keep_small``); if it has none, all
    are joined to one.
    """
    rows = sections(docs, id_col, text_col)
    split = F.filter(F.split(F.col("text"), r"\n(?=### )"), lambda x: F.trim(x, F.lit(" \n")) != "")
    pieces = F.when(X.estimated_tokens(F.col("text")) > most, packed(split, most)).otherwise(F.array("text"))
    out = rows.select(id_col, "position", "heading", F.posexplode(pieces).alias("part", "text")).withColumn("tokens", X.estimated_tokens(F.col("text")))
    by_doc = W.partitionBy(id_col)
    out = out.withColumn("longer", F.max(F.col("tokens") >= least).over(by_doc))
    some = out.where("longer") if keep_small else out.where(f"longer and tokens >= {least}")
    order = F.struct("position", "part", "heading", "text")
    none = out.where("not longer").groupBy(id_col).agg(F.array_sort(F.collect_list(order)).alias("all"))
    none = none.select(id_col, F.get("all", F.lit(0))["position"].alias("position"), F.lit(0).alias("part"), F.get("all", F.lit(0))["heading"].alias("heading"), F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"))
    none = none.withColumn("tokens", X.estimated_tokens(F.col("text")))
    out = some.drop("longer").unionByName(none)
    out = out.withColumn("chunk", F.row_number().over(W.partitionBy(id_col).orderBy("position", "part")) - 1).drop("position", "part")
    return out.withColumns({"has_table": F.col("text").rlike(r"\|.*\|.*\|"), "has_mermaid": F.contains("text", F.lit("```mermaid")), "has_images": F.col("text").rlike(r"!\[[^\]]*\]\(")})


def with_context(heading: Column, context: Column, text: Column) -> Column:
    return F.concat(F.lit("["), context, F.lit("]\n## "), heading, F.lit("\n\n"), text)


def description(text: Column) -> Column:
    """The first line of more than ten characters that is no heading, quote, table, list or fence."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & ~x.rlike(r"^(#|>|\||[-*+] |```|---)")), F.lit(0))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, level, title, ends): headings outside fences; a section ends before the next heading of its level or a higher one (null: at the end)."""
    rows = lines(docs, id_col, text_col)
    w = W.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("fences", F.sum(F.trim("line").startswith("```").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.where((F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,6} ")).select(id_col, "pos", F.length(F.regexp_extract("line", "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))
    later = w.rowsBetween(1, W.unboundedFollowing)
    ends = F.least(*[F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("pos"))).over(later)) for k in range(1, 7)])
    return found.withColumn("ends", ends)


def section_lines(docs: DataFrame, title: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line) of the first section whose heading is, holds or is held by ``title``."""
    want = title.strip().lower()
    t = F.lower("title")
    rank = F.when(t == want, 0).when(t.contains(want) | (F.lit(want).contains(t) & (t != "")), 1)
    found = headings(docs, id_col, text_col).withColumn("rank", rank).where("rank is not null").groupBy(id_col).agg(F.min(F.struct("rank", "pos", "ends")).alias("f"))
    return lines(docs, id_col, text_col).join(found, id_col).where("pos >= f.pos and (f.ends is null or pos < f.ends)").select(id_col, "pos", "line")


def tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table, row, cells): rows of Markdown tables, numbered from 0; rows of rules go."""
    rows = lines(docs, id_col, text_col).withColumn("is_row", F.trim("line").rlike(r"^\|.*\|$"))
    w = W.partitionBy(id_col).orderBy("pos")
    begins = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))
    rows = rows.withColumn("table", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).where("is_row")
    rows = rows.where(~F.trim("line").rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\|", ""), r"\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    return rows.select(id_col, "table", (F.row_number().over(W.partitionBy(id_col, "table").orderBy("pos")) - 1).alias("row"), cells.alias("cells"))


def images(text: Column) -> Column:
    """(alt, path) of image references in order."""
    both = lambda g: F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(g))
    return F.zip_with(both(1), both(2), lambda a, p: F.struct(a.alias("alt"), p.alias("path")))


def records(text: Column) -> Column:
    """Records parted by blank lines, each of ``... key value`` lines, as an array of maps."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: b.contains("... "))
    entry = lambda b: F.map_from_arrays(F.regexp_extract_all(b, F.lit(r"(?m)^\.\.\. (\S+) "), F.lit(1)), F.regexp_extract_all(b, F.lit(r"(?m)^\.\.\. \S+ (.*)$"), F.lit(1)))
    return F.transform(blocks, entry)


def change_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, change, user, day, description) of ``Change n on day by user`` headers with indented text below."""
    rows = lines(docs, id_col, text_col)
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum(F.col("line").rlike(r"^Change \d+ on ").cast("int")).over(w)).where("n > 0")
    head = F.max(F.when(F.col("line").rlike(r"^Change \d+ on "), F.col("line")))
    body = F.array_sort(F.collect_list(F.when(F.col("line").rlike(r"^[\t ]+\S"), F.struct("pos", F.trim(F.col("line"), F.lit("\t ")).alias("line")))))
    out = rows.groupBy(id_col, "n").agg(head.alias("head"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("description"))
    part = lambda g: F.regexp_extract("head", r"^Change (\d+) on (\S+)(?: \S+)? by ([^\s@]+)", g)
    return out.select(id_col, part(1).cast("long").alias("change"), part(3).alias("user"), part(2).alias("day"), "description")
