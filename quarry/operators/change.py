"""What a crawl changed: comparison of two states of a table, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(stored: DataFrame, crawled: DataFrame, key: str, mark: str, full: bool = True) -> DataFrame:
    """(key, change): new, changed, unchanged or, of a full crawl, deleted.

    A null mark in the crawl says nothing and counts as unchanged. Keys are unique on each side.
    """
    old = stored.select(F.col(key), F.col(mark).alias("old_mark"), F.lit(True).alias("was"))
    new = crawled.select(F.col(key), F.col(mark).alias("new_mark"), F.lit(True).alias("now"))
    both = old.join(new, key, "full_outer" if full else "right_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("new_mark").isNull() | F.col("old_mark").eqNullSafe(F.col("new_mark")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def newer_versions(local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): remote keys that are new here, or have a greater version."""
    here = local.select(key, F.col(version).alias("here"))
    both = remote.join(here, key, "left")
    change = F.when(F.col("here").isNull(), "new").when(F.col(version) > F.col("here"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The state after the rows: a row's values that aren't null replace the stored ones; other keys stay.

    Of several rows for a key the caller keeps one first (see ``latest``).
    """
    have = stored.select(F.col(key), F.struct("*").alias("old"))
    got = rows.select(F.col(key), F.struct(*[c for c in stored.columns if c in rows.columns]).alias("new"))
    values = [F.coalesce(F.col(f"new.`{c}`"), F.col(f"old.`{c}`")).alias(c) if c in rows.columns else F.col(f"old.`{c}`").alias(c) for c in stored.columns]
    return have.join(got, key, "full_outer").select(*values)


def upsert_joining_lists(stored: DataFrame, rows: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Like ``upsert``, but array columns of ``lists`` become the sorted union of both."""
    out = upsert(stored, rows.drop(*lists), key)
    more = rows.select(key, *[F.col(c).alias(f"{c} more") for c in lists])
    joined = out.join(more, key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(stored.schema[c.removesuffix(" more")].dataType))
    return joined.withColumns({c: F.array_sort(F.array_union(empty(c), empty(f"{c} more"))) for c in lists}).select(*stored.columns)


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place ", place).where(F.col("place ") == 1).drop("place ")


def cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def not_queued(documents: DataFrame, jobs: DataFrame, key: str, busy: tuple[str, ...] = ("pending", "assigned", "running")) -> DataFrame:
    """Documents without a job that waits or runs."""
    return documents.join(jobs.where(F.col("status").isin(*busy)).select(key), key, "left_anti")


def stale_outputs(sources: DataFrame, outputs: DataFrame, key: str, time: str) -> DataFrame:
    """Sources without an output, or newer than it."""
    made = outputs.select(key, F.col(time).alias("made"))
    return sources.join(made, key, "left").where(F.coalesce(F.col(time) > F.col("made"), F.lit(True))).drop("made")


def orphans(names: DataFrame, titles: DataFrame, name: str, title: str, prefix: int = 8) -> DataFrame:
    """(name, title): names that a longer title begins with, cut short by a limit of length.

    Joined by their first ``prefix`` characters, then tested; names shorter than that are compared with all titles of
    their own length's prefix.
    """
    short = names.select(F.col(name)).where(F.length(name) > 0).withColumn("k", F.left(name, F.least(F.length(name), F.lit(prefix))))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length(title), F.lit(prefix))))
    long = titles.select(F.col(title)).where(F.length(title) > 0).select(title, sizes.alias("size")).withColumn("k", F.left(F.col(title), F.col("size"))).drop("size")
    return short.join(long, "k").where(F.col(title).startswith(F.col(name)) & (F.length(title) > F.length(name))).select(name, title).distinct()
