"""Jobs, versions and schedules as functions from one state of a table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_jobs(jobs: DataFrame, worker_types: list[str] | None = None, n: int = 1) -> DataFrame:
    """The ``n`` pending jobs to be done next: by priority, then age, then id."""
    open_ = jobs.where(F.col("status") == "pending")
    if worker_types is not None:
        open_ = open_.where(F.col("worker_type").isin(*worker_types))
    return open_.orderBy(F.asc_nulls_first("priority"), F.asc_nulls_first("created_at"), "id").limit(n)


def claim(jobs: DataFrame, worker: str, now: Column, worker_types: list[str] | None = None) -> DataFrame:
    """The state in which ``worker`` has the next job. One writer at a time: this is no lock."""
    taken = next_jobs(jobs, worker_types).select("id", F.lit(True).alias("taken "))
    out = jobs.join(F.broadcast(taken), "id", "left")
    put = lambda c, v: F.when(F.col("taken "), v).otherwise(F.col(c)).alias(c)
    change = {"status": F.lit("assigned"), "worker_id": F.lit(worker), "assigned_at": now}
    return out.select([put(c, change[c]) if c in change else F.col(c) for c in jobs.columns])


def finish(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Jobs after ``results`` (id, ok, message): done; or, failed, pending again until retries are used up."""
    out = jobs.join(results.select("id", "ok", "message"), "id", "left")
    again = ~F.col("ok") & (F.col("retry_count") < F.col("max_retries"))
    change = {
        "status": F.when(F.col("ok"), "completed").when(again, "pending").when(~F.col("ok"), "failed").otherwise(F.col("status")),
        "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "error_message": F.when(~F.col("ok"), F.col("message")).otherwise(F.col("error_message")),
        "completed_at": F.when(F.col("ok"), now).otherwise(F.col("completed_at")),
    }
    return out.select([change[c].alias(c) if c in change else F.col(c) for c in jobs.columns])


def reset_stale(jobs: DataFrame, now: Column, seconds: int, job_types: list[str] | None = None) -> DataFrame:
    """Running and assigned jobs older than ``seconds`` wait again."""
    old = F.col("status").isin("running", "assigned") & (F.coalesce("started_at", "assigned_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    if job_types is not None:
        old = old & F.col("job_type").isin(*job_types)
    return jobs.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def next_version(versions: DataFrame, keys: list[str]) -> DataFrame:
    return versions.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def activate(versions: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly the chosen version of each key in ``chosen`` (keys, version) is active; other keys stay as they are."""
    pick = chosen.select(*keys, F.col("version").alias("chosen "))
    out = versions.join(pick, keys, "left")
    active = F.when(F.col("chosen ").isNull(), F.col("is_active")).otherwise((F.col("version") == F.col("chosen ")).cast("int"))
    return out.withColumn("is_active", active).select(*versions.columns)


def active_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest active version of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("version")))
    return versions.where("is_active = 1").withColumn("place ", place).where(F.col("place ") == 1).drop("place ")


def due(schedule: Column, last: Column, now: Column) -> Column:
    """Whether a schedule asks for a run: hourly after an hour; daily after 20 hours, from 3 o'clock on; weekly after 6 days, Mondays from 3."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 3600
    late = F.hour(now) >= 3
    rule = F.when(schedule == "hourly", hours >= 1).when(schedule == "daily", (hours >= 20) & late).when(schedule == "weekly", (hours >= 144) & (F.weekday(now) == 0) & late).otherwise(False)
    return F.when(F.coalesce(schedule, F.lit("manual")) == "manual", False).when(last.isNull(), True).otherwise(rule)


def to_enqueue(sources: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Sources that are due and have no job waiting or running."""
    busy = jobs.where(F.col("status").isin("pending", "assigned", "running")).select("source_id")
    return sources.where(due(F.col("schedule"), F.col("last_run"), now)).join(busy, "source_id", "left_anti")


def alive(heartbeats: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Workers seen within so many seconds; their latest row each."""
    newest = heartbeats.groupBy("worker_id").agg(F.max("last_seen").alias("last_seen"))
    return newest.where(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def newest_per_stage(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One job of each key: running before assigned before pending before ended, then the newest, then the smallest id."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "assigned", 1).when(F.col("status") == "pending", 2).otherwise(3)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(rank, F.desc("created_at"), "id"))
    return jobs.withColumn("place ", place).where(F.col("place ") == 1).drop("place ")
