import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import events
from quarry.streaming import logs

T0 = dt.datetime(2024, 1, 1, 12)


def test_ingest_goes_on_where_it_ended(spark, tmp_path):
    schema = "ts timestamp, source string, level string, message string"
    def write(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    write([(T0, "app", "loud", "a"), (T0, "no", "info", "b"), (T0, "app", "info", None)])
    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        logs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ("app",), {"availableNow": True}).awaitTermination(120)
        return [(r.message, r.level) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("message").collect()]
    assert run() == [("a", "info")]
    write([(T0 + dt.timedelta(days=1), "app", "WARN", "c")])
    assert run() == [("a", "info"), ("c", "warn")]


def test_stream_join_is_the_batch_join(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    reports = rows.where("event_type = 'error'").select(F.col("event_id").alias("report_id"), F.col("ts").alias("report_ts"), F.col("user_id").alias("machine_id"))
    found = rows.select(F.col("event_id").alias("log_id"), "ts", F.col("user_id").alias("machine_id"))
    reports.write.parquet(str(tmp_path / "r"))
    found.write.parquet(str(tmp_path / "l"))
    stream = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    joined = logs.before_reports(stream("r", reports), stream("l", found), 600, late="60 days")
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.report_id, r.log_id) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = events.before_each(reports.withColumnRenamed("machine_id", "user_id"), found.withColumnRenamed("machine_id", "user_id"), ["user_id"], F.lit(600), most=None)
    assert got == {(r.report_id, r.log_id) for r in batch.collect()}


def test_marks_and_windows(spark, sf_dir):
    rows = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(hours=1))], "id int, modified timestamp")
    assert logs.new_since(rows, None).count() == 2 and [r.id for r in logs.new_since(rows, T0).collect()] == [2]
    assert logs.high_water(rows).first().mark == T0 + dt.timedelta(hours=1)
    counted = logs.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert counted.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
