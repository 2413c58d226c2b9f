"""Joins by likeness: containment, near spelling, best ratio, and first match of several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fuzzy(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int = 3, prefix: int = 3, best: int = 5) -> DataFrame:
    """(left, right, distance): for each left value its ``best`` nearest right ones that start alike and are within ``most`` edits."""
    a = left.select(F.col(left_col).alias("left")).distinct().withColumn("k", F.left("left", F.lit(prefix)))
    b = right.select(F.col(right_col).alias("right")).distinct().withColumn("k", F.left("right", F.lit(prefix)))
    near = a.join(b, "k").where((F.abs(F.length("left") - F.length("right")) <= most) & (F.col("left") != F.col("right")))
    near = near.withColumn("distance", F.levenshtein("left", "right", most)).where("distance >= 0")
    place = F.row_number().over(W.partitionBy("left").orderBy("distance", "right"))
    return near.withColumn("place", place).where(F.col("place") <= best).select("left", "right", "distance")


def containing(names: DataFrame, texts: DataFrame, name: str, text_id: str, text: str) -> DataFrame:
    """(name, text id) of every text that holds the name as a run of whole words.

    Both sides become word n-grams of the names' lengths and meet by equality, so it is no
    product of names and texts. All lengths in words that ``names`` has are read first.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    parts = names.select(F.col(name), words(F.col(name)).alias("w")).where(F.size("w") > 0)
    sizes = sorted(r["n"] for r in parts.select(F.size("w").alias("n")).distinct().collect())
    split = texts.select(F.col(text_id), words(F.col(text)).alias("w"))
    if not sizes:
        return names.select(name).join(texts.select(text_id), F.lit(False))
    each = split.select(text_id, "w", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.size("w") >= F.col("n"))
    have = each.select(text_id, F.explode(F.array_distinct(_grams(F.col("w"), F.col("n")))).alias("g"))
    return parts.select(name, F.array_join("w", " ").alias("g")).join(have, "g").select(name, text_id).distinct()


def _grams(words: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))


def alike(left: DataFrame, right: DataFrame, left_col: str, right_col: str, least: float = 0.5, gram: int = 3) -> DataFrame:
    """(left, right, ratio): for each left name the right one that equals it, or contains it or is contained in it with the greatest ratio of lengths over ``least``.

    Candidates share a character n-gram of the shorter name; of a name shorter than ``gram`` that is its whole, which names
    near enough in length send as well.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\"']+", " ")
    a = left.select(F.col(left_col).alias("left")).distinct().withColumn("x", norm(F.col("left")))
    b = right.select(F.col(right_col).alias("right")).distinct().withColumn("y", norm(F.col("right")))
    cuts = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
    own = lambda c: F.when(F.length(c) >= gram, cuts(c, gram)).otherwise(F.array(c))
    shorter = lambda c: [F.when((F.length(c) > n) & (F.length(c) * least < n), cuts(c, n)).otherwise(F.array().cast("array<string>")) for n in range(1, gram)]
    grams = lambda c: F.explode(F.array_distinct(F.concat(own(c), *shorter(c))))
    met = a.withColumn("g", grams(F.col("x"))).join(b.withColumn("g", grams(F.col("y"))), "g").select("left", "x", "right", "y").distinct()
    ratio = F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    met = met.withColumn("ratio", F.when(F.col("x") == F.col("y"), 1.0).when(F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")), ratio).otherwise(0.0))
    place = F.row_number().over(W.partitionBy("left").orderBy(F.desc("ratio"), "right"))
    return met.where(F.col("ratio") > least).withColumn("place", place).where("place = 1").select("left", "right", "ratio")


def first_match(rows: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Adds ``value`` from the first of the lookups (frame, keys) that has it for the row."""
    out, found = rows, []
    for i, (frame, keys) in enumerate(lookups):
        name = f"{value} {i}"
        out = out.join(frame.select(*keys, F.col(value).alias(name)).dropDuplicates(keys), keys, "left")
        found.append(F.col(name))
    return out.withColumn(value, F.coalesce(*found)).select(*rows.columns, value)


def compared(before: DataFrame, after: DataFrame, id_col: str, metrics: list[str]) -> DataFrame:
    """Ids of both runs with each metric before and after, its change in percent (null from 0) and an arrow."""
    a = before.select(id_col, *[F.col(m).alias(f"{m}_before") for m in metrics])
    b = after.select(id_col, *[F.col(m).alias(f"{m}_after") for m in metrics])
    out = a.join(b, id_col)
    for m in metrics:
        change = (F.col(f"{m}_after") - F.col(f"{m}_before")) * 100.0 / F.nullif(F.col(f"{m}_before"), F.lit(0))
        out = out.withColumn(f"{m}_percent", F.bround(change, 1)).withColumn(f"{m}_arrow", F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "same").otherwise("n/a"))
    return out


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct values both sides have, each has alone, and the share of the left's that the right has."""
    both = left.select(column).distinct().withColumn("l", F.lit(1)).join(right.select(column).distinct().withColumn("r", F.lit(1)), column, "full_outer")
    count = lambda cond: F.count_if(cond)
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
    return both.agg(count(l & r).alias("both"), count(l & ~r).alias("left_only"), count(~l & r).alias("right_only"), F.bround(count(l & r) * 100.0 / F.nullif(count(l), F.lit(0)), 2).alias("percent_of_left"))
