"""Log ingest and window joins over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.events import valid_logs


def ingest(stream: DataFrame, out: str, checkpoint: str, sources: tuple[str, ...], trigger: dict | None = None):
    """Writes valid log rows, by day, to a folder; a restart goes on where the last run ended, and nothing is dropped for want of room."""
    rows = valid_logs(stream, F.current_timestamp(), sources).withColumn("ingest_ts", F.current_timestamp()).withColumn("day", F.to_date("ts"))
    return rows.writeStream.partitionBy("day").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def before_reports(reports: DataFrame, logs: DataFrame, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Stream of (report_id, log_id, ts): logs of the report's machine in the minutes before it; state older than the watermarks is let go."""
    r = reports.withWatermark("report_ts", late).select("report_id", "report_ts", F.col("machine_id").alias("machine"))
    on = F.expr(f"machine_id = machine AND ts BETWEEN report_ts - INTERVAL {int(minutes)} MINUTES AND report_ts")
    return logs.withWatermark("ts", late).join(r, on).select("report_id", "log_id", "ts")


def new_since(rows: DataFrame, mark, ts: str = "modified") -> DataFrame:
    """Rows newer than a stored high-water mark (all without one)."""
    return rows if mark is None else rows.where(F.col(ts) > F.lit(mark))


def high_water(rows: DataFrame, ts: str = "modified") -> DataFrame:
    return rows.agg(F.max(ts).alias("mark"))


# Extensions: what Spark offers beyond the operators that the engine sets out to match.


def windowed_counts(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, with a watermark (an extension)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark (an extension)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
