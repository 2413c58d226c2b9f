"""Lookups and searches beside the chunk retrieval: glossary, tables, notes on other products, plan steps."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X


def glossary(terms: DataFrame, word: str, limit: int = 10) -> DataFrame:
    """Entries whose term is the word; if there is none, those whose term holds it or is held by it.

    ``terms``: term, meaning. Which of the two holds is told in one pass: exact entries have rank 0, and only the least rank stays.
    """
    low, w = F.lower(F.trim("term")), word.strip().lower()
    rank = F.when(low == w, 0).when(low.contains(w) | (F.lit(w).contains(low) & (low != "")), 1)
    found = terms.withColumn("rank", rank).where("rank is not null").orderBy("rank", "term").limit(limit)
    return found.withColumn("least", F.min("rank").over(W.partitionBy())).where("rank = least").select("term", "meaning")


def table_at(tables: DataFrame, workbook: str | None = None, sheet: str | None = None, table_id: str | None = None, name: str | None = None) -> DataFrame:
    """The table with these keys, or the first whose name holds ``name``."""
    rows = tables
    for column, value in (("workbook", workbook), ("sheet", sheet), ("table_id", table_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if name is None else rows.where(F.lower("table_name").contains(name.strip().lower()))
    return rows.orderBy("workbook", "sheet", "table_id").limit(1)


def listed(tables: DataFrame, workbook: str = "", sheet: str = "") -> DataFrame:
    return tables.where(F.lower("workbook").contains(workbook.lower()) & F.lower("sheet").contains(sheet.lower())).orderBy("workbook", "sheet", "table_id")


def canonical_name(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """(name, canonical): by alias, hyphens and underscores being blanks; else the name so formed. ``aliases``: alias, canonical."""
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[-_\s]+", " "))
    known = aliases.select(form(F.col("alias")).alias("key"), "canonical").dropDuplicates(["key"])
    return names.select(name, form(F.col(name)).alias("key")).join(known, "key", "left").select(name, F.coalesce("canonical", "key").alias("canonical"))


def node_search(nodes: DataFrame, word: str, per_game: int = 5) -> DataFrame:
    """(game, name, score): 100 for the name, 30 for the category, and the text's length, for nodes that hold the word."""
    w = word.lower()
    name, category, text = (F.lower(F.coalesce(c, F.lit(""))).contains(w) for c in ("name", "category", "text"))
    score = F.when(name, 100).otherwise(0) + F.when(category, 30).otherwise(0) + F.length(F.coalesce("text", F.lit("")))
    found = nodes.where(name | category | text).withColumn("score", score)
    place = F.row_number().over(W.partitionBy("game").orderBy(F.desc("score"), "name"))
    return found.withColumn("rank", place).where(F.col("rank") <= per_game).select("game", "name", "score", "rank")


def raw_search(files: DataFrame, word: str, per_game: int = 3, snippets: int = 3) -> DataFrame:
    """(game, path, hits, snippets): the files of each game with most hits."""
    low, w = F.lower("text"), F.lit(word.lower())
    found = files.withColumn("hits", X.count_of(low, w)).where("hits > 0")
    place = F.row_number().over(W.partitionBy("game").orderBy(F.desc("hits"), "path"))
    return found.withColumn("rank", place).where(F.col("rank") <= per_game).select("game", "path", "hits", X.snippets(F.col("text"), w, snippets).alias("snippets"))


def mentions_together(files: DataFrame, names: list[str], words: list[str]) -> DataFrame:
    """Files that hold any form of the name and any form of the word."""
    any_of = lambda forms: reduce(or_, (F.lower("text").contains(f.lower()) for f in forms), F.lit(False))
    return files.where(any_of(names) & any_of(words))


def aliases_of(sheets: DataFrame, synonyms: DataFrame, prefix: str = "PK_") -> DataFrame:
    """(alias, target, weight): names by which a workbook is known: its own, without prefix, blanks or version, its sheets, and their synonyms.

    ``sheets``: workbook, sheet; ``synonyms``: word, other.
    """
    bare = F.regexp_replace("workbook", f"^{re.escape(prefix)}", "")
    forms = [(F.col("workbook"), 1.0), (bare, 1.0), (F.regexp_replace(bare, r"[\s_]+", " "), 0.9), (F.regexp_replace(bare, r"[\s_]+", ""), 0.9), (F.regexp_replace(bare, r"[\s_]*v?\d+(\.\d+)*$", ""), 0.8), (F.col("sheet"), 0.6)]
    rows = sheets.select(F.col("workbook").alias("target"), F.explode(F.array(*[F.struct(F.lower(F.trim(c)).alias("alias"), F.lit(w).alias("weight")) for c, w in forms])).alias("a")).select("a.alias", "target", "a.weight")
    more = rows.join(synonyms.select(F.lower("word").alias("alias"), F.lower("other").alias("other")), "alias").select(F.col("other").alias("alias"), "target", (F.col("weight") * 0.9).alias("weight"))
    return rows.unionByName(more).where(F.length("alias") >= 2).groupBy("alias", "target").agg(F.max("weight").alias("weight"))


def merged_retry(first: DataFrame, again: DataFrame, least: float = 0.8) -> DataFrame:
    """The first results, and of a second search those with new ids, at ``least`` at the lowest."""
    new = again.join(first.select("id"), "id", "left_anti").withColumn("score", F.greatest(F.col("score"), F.lit(least)))
    return first.unionByName(new.select(*first.columns))


def first_reason(layers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, reason): every key that some layer has, with the first that has it."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("rank"), F.lit(name).alias("reason")) for i, (name, df) in enumerate(layers)])
    return rows.groupBy(key).agg(F.min_by("reason", "rank").alias("reason"))


def distinct_questions(questions: DataFrame, size: int = 20) -> DataFrame:
    """One question of those that begin alike: the smallest id."""
    key = F.left(F.regexp_replace(F.lower("query"), r"\s+", ""), F.lit(size))
    return questions.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("id"))).where("place = 1").drop("place")


INTERNAL = r"(?:[A-Za-z]:\\|/(?:home|Users|mnt|srv|var|tmp)/|\\\\)[^\s\"'<>|]+"


def without_internal_paths(text: Column) -> Column:
    """(text, warnings): paths of a machine replaced by ``[path]``, and which they were."""
    return F.struct(F.regexp_replace(text, INTERNAL, "[path]").alias("text"), F.array_distinct(F.regexp_extract_all(text, F.lit(INTERNAL), F.lit(0))).alias("warnings"))


def by_rules(path: Column, rules: list[tuple[str, str]], other: str = "unknown") -> Column:
    """The label of the first pattern that a path matches."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(path.rlike(pattern), label).otherwise(out)
    return out
