"""Markdown, JSON and line files as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of every file below a path."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def preferred_pages(texts: DataFrame, preferred: str = "content_enriched.md", least: int = 50) -> DataFrame:
    """(folder, path, text): of each folder the enriched page, or else the plain one; pages under ``least`` bytes go."""
    rows = texts.where(F.octet_length("text") >= least).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.desc(F.col("path").endswith(preferred)), "path"))
    return rows.withColumn("place", place).where("place = 1").select("folder", "path", "text")


FOUNDATION = "source_file string, sheet_name string, tables array<struct<table_id:string,table_name:string,description:string,headers:array<struct<name:string>>,rows:array<array<string>>,sample_queries:array<string>,notes:string>>"


def foundation_tables(spark: SparkSession, path: str) -> DataFrame:
    """(workbook, sheet, table_id, table_name, description, sample_queries, text): a row for each table, its text as Markdown."""
    rows = spark.read.schema(FOUNDATION).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    t = rows.select(F.col("source_file").alias("workbook"), F.col("sheet_name").alias("sheet"), F.explode("tables").alias("t"))
    heads = F.array_join(F.transform("t.headers", lambda h: F.coalesce(h["name"], F.lit(""))), " | ")
    body = F.array_join(F.transform("t.rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    return t.select("workbook", "sheet", "t.table_id", "t.table_name", "t.description", "t.sample_queries", F.concat_ws("\n", F.concat(F.lit("### "), F.col("t.table_name")), "t.description", heads, body, "t.notes").alias("text"))


def table_hits(tables: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Tables by where the query stands: name, then description, then a sample question; with a snippet."""
    from quarry.functions import text as X

    q = query.strip().lower()
    sample = F.get(F.filter("sample_queries", lambda s: F.lower(s).contains(q)), F.lit(0))
    rank = F.when(F.lower("table_name").contains(q), 1).when(F.lower("description").contains(q), 2).when(sample.isNotNull(), 3)
    where = F.when(rank == 1, F.col("table_name")).when(rank == 2, X.snippet(F.col("description"), F.lit(q))).otherwise(sample)
    out = tables.withColumns({"rank": rank, "snippet": where}).where("rank is not null")
    return out.orderBy("rank", "workbook", "sheet", "table_id").limit(limit)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (system, table count, description) and edges (src, dst) of a knowledge graph's JSON."""
    kind = "systems map<string, struct<related_systems:array<string>,tables:int,sheet_count:int,total_size:bigint,description:string>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("systems").alias("system", "v"))
    return rows.select("system", "v.tables", "v.sheet_count", "v.total_size", "v.description"), rows.select(F.col("system").alias("src"), F.explode("v.related_systems").alias("dst"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that couldn't be read."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    lines = spark.read.text(path)
    broken = lines.where(F.trim("value") != "").where(F.try_parse_json("value").isNull())
    return rows.where("_broken is null").drop("_broken"), broken


def new_sources(have: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """Listed sources whose name isn't known; known ones are never changed."""
    return listed.join(have.select(key), key, "left_anti")
