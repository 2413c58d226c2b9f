"""State of crawled resources and the log of what changed it, from one table of commands.

A command has a number. What a resource keeps of its commands are the last ones of each kind, by number, and the first that made
it; keeping the greater of two is the same in any order, so batches may come in any order, twice, or all at once. The
state that users see is read off what is kept, and the log, read as commands again, gives the same state.

``commands``: seq, at, source, path, action (``upsert``, ``purge``, ``stale``, ``failed``; ``stale_all`` without a path), resource_id, modified,
content_hash, chunk_count, status (of an upsert), error. Numbers tell commands apart; null numbers, sources and, but for ``stale_all``, paths do nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum

FACTS = ("resource_id", "modified", "content_hash", "chunk_count", "status", "error")
# States of a resource, and how much of an error is kept.
FRESH, STALE, FAILED, PURGED, ERROR_CHARS = "fresh", "stale", "failed", "purged", 500
_MARKS = {"purge": PURGED, "stale": STALE, "failed": FAILED}


def kept(commands: DataFrame) -> DataFrame:
    """(source, path, born, upsert, purge, stale, failed, all): of each resource its last command of each kind and its first upsert's number; path is null for what is said of a whole source."""
    known = F.col("action").isin("upsert", *_MARKS) & F.col("path").isNotNull() | (F.col("action") == "stale_all")
    rows = commands.where(F.col("seq").isNotNull() & F.col("source").isNotNull() & known)
    path = F.when(F.col("action") != "stale_all", F.col("path")).alias("path")
    error = F.left("error", F.lit(ERROR_CHARS)).alias("error")
    when = lambda action, value: F.when(F.col("action") == action, value)
    full = F.struct("seq", "at", *[error if c == "error" else F.coalesce(c, F.lit(FRESH)).alias(c) if c == "status" else F.coalesce(c, F.lit(0)).alias(c) if c == "chunk_count" else F.col(c) for c in FACTS])
    mark = F.struct("seq", "at", error)
    rows = rows.select("source", path, when("upsert", F.col("seq")).alias("born"), when("upsert", full).alias("upsert"), *[when(a, mark).alias(a) for a in _MARKS], when("stale_all", mark).alias("all"))
    return _merged(rows)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "path").agg(F.min("born").alias("born"), *[F.max_by(c, F.col(c)["seq"]).alias(c) for c in ("upsert", *_MARKS, "all")])


def after(kept_before: DataFrame, commands: DataFrame) -> DataFrame:
    """What is kept after another batch of commands, whichever numbers it has."""
    return _merged(kept_before.unionByName(kept(commands)))


def state(kept_rows: DataFrame) -> DataFrame:
    """(source, path, resource_id, modified, content_hash, chunk_count, status, error, indexed_at): resources as they are.

    Marks of resources that no upsert made do nothing. A purge leaves no chunks; what is purged isn't made stale with its source, only by
    itself. The last error stays until the next upsert.
    """
    whole = kept_rows.where("path is null and all is not null").select("source", F.col("all").alias("whole"))
    rows = kept_rows.where("path is not null and upsert is not null").drop("all").join(whole, "source", "left")
    seq = lambda c: F.coalesce(F.col(c)["seq"], F.lit(-(1 << 62)))
    later = lambda c: F.when(seq(c) > F.col("upsert")["seq"], F.struct(seq(c).alias("seq"), F.col(c)["at"].alias("at"), F.lit(_MARKS[c]).alias("status")))
    own = F.struct(F.col("upsert")["seq"].alias("seq"), F.col("upsert")["at"].alias("at"), F.col("upsert")["status"].alias("status"))
    last = F.array_max(F.array_compact(F.array(own, *[later(c) for c in _MARKS])))
    rows = rows.withColumn("last", last)
    again = (seq("whole") > F.col("last")["seq"]) & (F.col("last")["status"] != PURGED)
    gone, wrong = seq("purge") > F.col("upsert")["seq"], seq("failed") > F.col("upsert")["seq"]
    return rows.select(
        "source", "path", *[F.col("upsert")[c].alias(c) for c in FACTS[:3]], F.when(gone, 0).otherwise(F.col("upsert")["chunk_count"]).alias("chunk_count"),
        F.when(again, STALE).otherwise(F.col("last")["status"]).alias("status"), F.when(wrong, F.col("failed")["error"]).otherwise(F.col("upsert")["error"]).alias("error"), F.when(again, F.col("whole")["at"]).otherwise(F.col("last")["at"]).alias("indexed_at"),
    )


def log(commands: DataFrame) -> DataFrame:
    """(seq, at, source, path, action, detail, FACTS): what each command did, as rows that are only ever added.

    ``added`` (or the state that an upsert names), ``purged``, ``stale`` and, known or not, ``failed``; purged and stale ones of resources that aren't known are left
    out. ``stale_all`` tells how many resources of its source it made wait: sums of comings and goings, by ranges of numbers, so that no source is one task's.
    """
    rows = commands.where("seq is not null and source is not null and (path is not null or action = 'stale_all')").dropDuplicates(["seq"])
    born = rows.where("action = 'upsert'").groupBy("source", "path").agg(F.min("seq").alias("born"))
    known = rows.where("action <> 'stale_all'").join(born, ["source", "path"], "left").where("action in ('upsert', 'failed') or born < seq and action in ('purge', 'stale')")
    did = F.when(F.col("action") == "upsert", F.when(F.coalesce("status", F.lit(FRESH)) == FRESH, "added").otherwise(F.col("status"))).when(F.col("action") == "purge", PURGED).otherwise(F.col("action"))
    single = known.select("seq", "at", "source", "path", did.alias("action"), "error", *FACTS[:5])
    # +1 where a resource comes to be one that can wait, -1 where it ceases to be
    from pyspark.sql import Window as W

    real = known.where("born <= seq")
    waits = F.when(F.col("action") == "upsert", F.coalesce("status", F.lit(FRESH)) != PURGED).otherwise(F.col("action") != "purge").cast("int")
    before = F.coalesce(F.lag("waits").over(W.partitionBy("source", "path").orderBy("seq")), F.lit(0))
    moves = real.withColumn("waits", waits).withColumn("change", F.col("waits") - before).where("change <> 0").select("source", "seq", F.col("change").cast("long").alias("change"), F.lit(None).cast("timestamp").alias("at"))
    asked = rows.where("action = 'stale_all'").select("source", "seq", F.lit(0).cast("long").alias("change"), F.col("at").cast("timestamp").alias("at"), F.lit(True).alias("asks"))
    summed = running_sum(moves.withColumn("asks", F.lit(False)).unionByName(asked), ["source"], "change", F.asc("seq"), out="waiting").where("asks")
    none = {c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("path", "error", *FACTS[:5])}
    whole = summed.select("seq", F.col("at").cast(dict(rows.dtypes)["at"]).alias("at"), "source", none["path"], F.lit("stale_all").alias("action"), F.concat(F.lit("queued "), "waiting").alias("error"), *[none[c] for c in FACTS[:5]])
    return single.unionByName(whole).select("seq", "at", "source", "path", "action", F.col("error").alias("detail"), *FACTS[:5])


def commands_of(entries: DataFrame) -> DataFrame:
    """A log's entries as commands again: folding them gives the state that the logged commands gave."""
    action = F.when(F.col("action") == PURGED, F.when(F.col("status").isNull(), "purge").otherwise("upsert"))
    marks = F.col("action").isin(STALE, FAILED) & F.col("status").isNull()
    action = action.when(marks, F.col("action")).when(F.col("action") == "stale_all", "stale_all").otherwise("upsert")
    return entries.select("seq", "at", "source", "path", action.alias("action"), *FACTS[:5], F.when(F.col("action") != "stale_all", F.col("detail")).alias("error"))
