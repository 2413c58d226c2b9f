"""What one task packs must not grow with the documents."""

from pyspark.sql import functions as F

from quarry.search import postings


def test_posting_tasks_follow_the_documents(spark, tmp_path):
    assert postings.shares(spark.range(0).withColumnRenamed("id", "doc_id")) == 1
    docs = spark.range(4 * postings.SHARE).select(F.col("id").alias("doc_id"))
    assert postings.shares(docs) == 4
    counts = docs.select(F.lit("x").alias("term"), F.col("doc_id").alias("id"), F.lit(1).alias("count"))
    postings.write(counts, str(tmp_path), buckets=1, tasks_a_bucket=postings.shares(docs))
    stretches = postings.blocks(spark, str(tmp_path), ["x"], buckets=1).groupBy(F.input_file_name().alias("file")).agg(F.sum("n").alias("n"), F.count_distinct("stretch").alias("s"))
    assert 1 < stretches.count() <= 4 and postings.by_frequency(spark, str(tmp_path)).first().docs == 4 * postings.SHARE
