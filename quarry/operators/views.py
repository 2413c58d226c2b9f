"""Roll-ups that a status page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import newest_per_stage

STAGES = ("crawl", "capture", "convert", "enrich", "index")


def stage_view(sources: DataFrame, documents: DataFrame, jobs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(source_id, stage, documents, waiting, running, failed, last_status): a row for each source and stage."""
    steps = sources.select(F.col("id").alias("source_id"), F.posexplode(F.array(*map(F.lit, stages))).alias("position", "stage"))
    have = documents.groupBy("source_id", "stage").agg(F.count(F.lit(1)).alias("documents"))
    work = jobs.groupBy("source_id", "stage").agg(*[F.count_if(F.col("status").isin(*of)).alias(name) for name, of in (("waiting", ("pending",)), ("running", ("assigned", "running")), ("failed", ("failed",)))])
    last = newest_per_stage(jobs, ["source_id", "stage"]).select("source_id", "stage", F.col("status").alias("last_status"))
    out = steps.join(have, ["source_id", "stage"], "left").join(work, ["source_id", "stage"], "left").join(last, ["source_id", "stage"], "left")
    return out.na.fill(0, ["documents", "waiting", "running", "failed"])


def stage_edges(stages: tuple[str, ...] = STAGES) -> list[tuple[str, str]]:
    return list(zip(stages[:-1], stages[1:], strict=True))


def system_features(chunks: DataFrame, most_sections: int = 20) -> DataFrame:
    """(workbook, sheets, chunks, tables, charts, size, sections) of each workbook."""
    rows = chunks.groupBy("workbook").agg(
        F.sort_array(F.collect_set("sheet")).alias("sheets"), F.count(F.lit(1)).alias("chunks"), F.sum(F.regexp_count("text", F.lit(r"(?m)^\|[\s:|-]+\|\s*$"))).alias("tables"),
        F.sum(F.regexp_count("text", F.lit("```mermaid"))).alias("charts"), F.sum(F.length("text")).alias("size"), F.slice(F.sort_array(F.collect_set("section_path")), 1, most_sections).alias("sections"),
    )
    return rows


def severity_counts(evidence: DataFrame) -> DataFrame:
    """(severity, conflicts) over distinct topics of pairs."""
    return evidence.select("pair_id", "topic", "severity").distinct().groupBy("severity").agg(F.count(F.lit(1)).alias("conflicts"))
