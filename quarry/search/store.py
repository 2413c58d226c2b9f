"""A stored collection of chunks with their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X

FACTS = ("workbook", "sheet", "section_path", "has_mermaid", "has_table", "has_images", "tokens", "source_path", "source_url", "chunk_type")


def entries(chunks: DataFrame, place: str, vector: str = "vector", text: str = "text") -> DataFrame:
    """(id, document, vector, facts): ``place`` numbers a section's chunks and ends the id; facts that a chunk lacks are empty, its type ``content``.

    Chunks of one id are one entry, that of the first text. Null names count as empty.
    """
    named = [F.coalesce(F.col(c), F.lit("")) for c in ("workbook", "sheet", "section_path")]
    dash = F.lit("")  # two underscores stand between an id's parts
    key = X.chunk_id(named[0], dash, named[1], dash, named[2], dash, F.col(place).cast("string"))
    default = {"source_url": F.lit(""), "chunk_type": F.lit("content")}
    facts = [(F.coalesce(F.col(c), default.get(c)) if c in default else F.col(c)).alias(c) if c in chunks.columns else default.get(c, F.lit(None).cast("string")).alias(c) for c in FACTS]
    rows = chunks.select(key.alias("id"), F.col(text).alias("document"), F.col(vector).alias("vector"), F.struct(*facts).alias("facts"))
    return rows.groupBy("id").agg(F.min_by(F.struct("document", "vector", "facts"), F.coalesce("document", F.lit(""))).alias("e")).select("id", "e.*")


def save(entries: DataFrame, path: str, buckets: int = 64) -> None:
    """Entries as Parquet below ``path``, in place of what stood there; ``bucket`` by id, so that one id is looked up in one folder."""
    entries.withColumn("bucket", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
