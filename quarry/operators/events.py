"""Logs and reports: windows before an event, pages, retention and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("debug", "info", "warn", "error")
MAX_MESSAGE = 8000


def valid_logs(batch: DataFrame, now: Column, sources: tuple[str, ...]) -> DataFrame:
    """Rows of a known source with a message; an unknown level becomes info, a missing time ``now``; long messages are cut."""
    known = F.lower("level").isin(*LEVELS)
    return batch.where(F.col("source").isin(*sources) & F.col("message").isNotNull()).withColumns({
        "level": F.when(known, F.lower("level")).otherwise("info"),
        "ts": F.coalesce(F.col("ts"), now),
        "message": F.left("message", F.lit(MAX_MESSAGE)),
    })


def before_each(reports: DataFrame, logs: DataFrame, on: list[str], minutes: Column, most: int | None = 5000, bucket_seconds: int = 600) -> DataFrame:
    """Logs of the same keys within so many minutes before each report, the newest ``most`` of each.

    ``reports``: report_id, report_ts and keys; ``logs``: log_id, ts and keys. A key that is null in
    the report matches any. Times are dealt to buckets, so a busy key is joined bucket by
    bucket rather than with all of its logs.
    """
    seconds = lambda c: F.unix_timestamp(c)
    spans = reports.withColumn("from ", F.col("report_ts") - F.make_dt_interval(mins=minutes))
    spans = spans.withColumn("bucket ", F.explode(F.sequence(F.floor(seconds("from ") / bucket_seconds), F.floor(seconds("report_ts") / bucket_seconds))))
    firm, loose = on[0], on[1:]
    own = logs.withColumn("bucket ", F.floor(seconds("ts") / bucket_seconds)).select("log_id", "ts", "bucket ", *[F.col(c).alias(f"log {c}") for c in on])
    joined = spans.join(own, (spans["bucket "] == own["bucket "]) & (F.col(firm) == F.col(f"log {firm}")))
    for c in loose:
        joined = joined.where(F.col(c).isNull() | (F.col(c) == F.col(f"log {c}")))
    found = joined.where((F.col("ts") >= F.col("from ")) & (F.col("ts") <= F.col("report_ts"))).select("report_id", "report_ts", "log_id", "ts")
    if most is None:
        return found
    place = F.row_number().over(W.partitionBy("report_id").orderBy(F.desc("ts"), F.desc("log_id")))
    return found.withColumn("place ", place).where(F.col("place ") <= most).drop("place ")


def page_after(rows: DataFrame, key: str, after: int | None, n: int, most: int = 5000) -> DataFrame:
    """The next page behind a key; 1 to ``most`` rows."""
    rows = rows if after is None else rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(max(1, min(n, most)))


def page_at(rows: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, n))


def retained_logs(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return logs.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


def retained_reports(reports: DataFrame, now: Column, days: int = 30, newest: int = 1000) -> DataFrame:
    """Reports of the last days, and the newest so many whatever their age.

    The newest are found as a small ordered page, not by ranking all rows in one task.
    """
    kept = reports.orderBy(F.desc("ts"), F.desc("report_id")).limit(newest).select("report_id")
    recent = reports.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
    older = reports.where(F.col("ts") < now - F.make_dt_interval(days=F.lit(days))).join(F.broadcast(kept), "report_id", "left_semi")
    return recent.unionByName(older)


def paired(events: DataFrame, key: str, kind: str, start: str, end: str, ts: str) -> DataFrame:
    """(key, started, ended, seconds) of keys that have both a start and an end; the first of each."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(ts)))
    out = events.where(F.col(kind).isin(start, end)).groupBy(key).agg(at(start).alias("started"), at(end).alias("ended")).where("started is not null and ended is not null")
    return out.withColumn("seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def gap_to_next(events: DataFrame, keys: list[str], kind: str, of: str, ts: str, order: list[str]) -> DataFrame:
    """For each event of kind ``of``: seconds until the next event of the key."""
    following = F.lead(ts).over(W.partitionBy(*keys).orderBy(*order))
    return events.withColumn("next ", following).where(F.col(kind) == of).withColumn("gap_seconds", F.unix_timestamp("next ") - F.unix_timestamp(ts)).drop("next ")


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """Adds the number (from 0) of the stretch without a gap of more than ``gap_seconds`` that an event is in."""
    w = W.partitionBy(*keys).orderBy(*order)
    cut = F.coalesce((F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap_seconds).cast("int"), F.lit(0))
    return events.withColumn("cut ", cut).withColumn("session", F.sum("cut ").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("cut ")


def since(text: str) -> tuple[str, int]:
    """``30m``, ``1h``, ``2d``, ``45s`` as a unit and a number."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return {"s": "secs", "m": "mins", "h": "hours", "d": "days"}[m[2]], int(m[1])


def after_cutoff(rows: DataFrame, ts: str, now: Column, text: str) -> DataFrame:
    unit, n = since(text)
    return rows.where(F.col(ts) >= now - F.make_dt_interval(**{unit: F.lit(n)}))
