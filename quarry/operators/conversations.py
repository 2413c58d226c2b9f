"""Conversations and their turns, as functions from state to state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranking


def appended(turns: DataFrame, new: DataFrame, *order, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with the new ones behind those of their conversation, numbered on from its last in ``order`` (from 0 in a new one).

    Columns that only one side has are null in the other. Equal new turns are several turns; no new turns change nothing.
    """
    last = turns.groupBy(key).agg(F.max(turn).alias("last "))
    numbered = ranking.running_sum(new.drop(turn).withColumn("one ", F.lit(1)), [key], "one ", *order, out="place ")
    behind = numbered.join(last, key, "left").withColumn(turn, F.coalesce(F.col("last "), F.lit(-1)) + F.col("place ")).drop("one ", "place ", "last ")
    return turns.unionByName(behind, allowMissingColumns=True)


def title_of(question: Column, given: Column | None = None) -> Column:
    """The title given, or else the question, cut at 40 characters."""
    cut = F.when(F.length(question) > 40, F.concat(F.left(question, F.lit(40)), F.lit("..."))).otherwise(question)
    return cut if given is None else F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(cut)


def summarised(turns: DataFrame, question: str = "text", key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, title, turn_count, last_turn): a row for each conversation, its title by its first turn."""
    rows = turns.groupBy(key).agg(F.min_by(question, turn).alias("first "), F.count(F.lit(1)).alias("turn_count"), F.max(turn).alias("last_turn"))
    return rows.select(key, title_of(F.col("first ")).alias("title"), "turn_count", "last_turn")


def forked(conversations: DataFrame, turns: DataFrame, wanted: DataFrame, now: Column, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Both tables with copies of the wanted conversations: ``wanted`` holds ``key`` and ``new_id``.

    A copy has the new id, a title with ``(fork)`` before it, both its times ``now`` and the turns as they are. Ids that
    aren't there give nothing.
    """
    fresh = lambda df: df.join(wanted.select(key, F.col("new_id").alias("new ")), key).withColumn(key, F.col("new ")).drop("new ")
    copies = fresh(conversations).withColumns({"title": F.concat(F.lit("(fork) "), F.coalesce("title", F.lit(""))), "created_at": now, "updated_at": now})
    return conversations.unionByName(copies.select(*conversations.columns)), turns.unionByName(fresh(turns).select(*turns.columns))


def votes(answers: DataFrame, *keys: str, vote: str = "vote") -> DataFrame:
    """(keys, n, up, down): answers, and those voted up or down; null and 0 are neither."""
    return answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(vote) > 0).alias("up"), F.count_if(F.col(vote) < 0).alias("down"))
