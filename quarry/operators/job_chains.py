"""Chains of jobs: events of a document's jobs folded to their state, as a batch or as a stream.

One event at a time, by number: a job is enqueued, started, completed or failed; a failed one waits again until its retries are used up, a completed one
enqueues the next stage. Both ways keep one document's few jobs in memory and read its events once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Which stage follows which.
NEXT_STAGE = {"capture": "convert", "download": "enrich"}
OPEN = ("pending", "assigned", "running")
JOBS = "document bigint, stage string, status string, retries int, error string, started_seq bigint, ended_seq bigint, runs int, seq bigint"
_FIELDS = [f.split()[0] for f in JOBS.split(", ")]


def step(jobs: dict[str, dict], seq: int, stage: str, event: str, error: str | None, next_stage: dict[str, str], max_retries: int) -> None:
    """One event of a document. Events of jobs that aren't there, or that don't fit the job's status, do nothing."""

    def enqueue(name: str) -> None:
        job = jobs.get(name)
        if job is None or job["status"] not in OPEN:
            jobs[name] = {"status": "pending", "retries": 0, "error": None, "started_seq": None, "ended_seq": None, "runs": (job["runs"] if job else 0) + 1, "seq": seq}

    job = jobs.get(stage)
    if event == "enqueue":
        enqueue(stage)
    elif job is None or job["status"] not in OPEN:
        return
    elif event == "start":
        job |= {"status": "running", "started_seq": seq, "seq": seq}
    elif event == "complete":
        job |= {"status": "completed", "ended_seq": seq, "seq": seq}
        if stage in next_stage:
            enqueue(next_stage[stage])
    elif event == "fail":
        job |= {"error": error, "seq": seq} | ({"status": "pending", "retries": job["retries"] + 1} if job["retries"] < max_retries else {"status": "failed", "ended_seq": seq})


def _rows(document, jobs: dict[str, dict]) -> list[tuple]:
    return [(document, stage, *[job[f] for f in _FIELDS[2:]]) for stage, job in jobs.items()]


def folded(events: DataFrame, next_stage: dict[str, str] | None = None, max_retries: int = 3) -> DataFrame:
    """(document, stage, status, retries, error, started_seq, ended_seq, runs, seq): each document's jobs after all its events.

    ``events``: document, seq, stage, event, error. Numbers tell a document's events apart; an event that comes twice counts once. Null documents, numbers,
    stages and events do nothing. Documents are dealt to tasks whole, sorted, and read as a stream, so one with very many events takes time but no memory.
    """
    follow = NEXT_STAGE if next_stage is None else next_stage
    rows = events.where("document is not null and seq is not null and stage is not null and event is not null").select(F.col("document").cast("long").alias("document"), F.col("seq").cast("long").alias("seq"), "stage", "event", "error")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, jobs, done, last = None, {}, [], None
        for batch in batches:
            for document, seq, stage, event, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if document != current:
                    done += _rows(current, jobs)
                    current, jobs, last = document, {}, None
                if seq != last:
                    step(jobs, seq, stage, event, error, follow, max_retries)
                last = seq
            if done:
                yield _batch(done)
                done = []
        yield _batch(done + _rows(current, jobs))

    return rows.repartition("document").sortWithinPartitions("document", "seq", "stage", "event").mapInArrow(fold, JOBS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(JOBS.split(", "))], _FIELDS)


def streamed(events: DataFrame, next_stage: dict[str, str] | None = None, max_retries: int = 3) -> DataFrame:
    """The same over a stream: after each batch the rows of every job of the documents it touched (see ``newest``).

    A document's events come in the order of their numbers from batch to batch; within a batch they may come in any order, and those up to the last number seen are
    known already and do nothing.
    """
    follow = NEXT_STAGE if next_stage is None else next_stage

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        jobs, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -(1 << 63))
        rows = pd.concat(list(parts)).sort_values(["seq", "stage", "event"])
        for r in rows.itertuples():
            if r.seq > last:
                step(jobs, int(r.seq), r.stage, r.event, r.error if isinstance(r.error, str) else None, follow, max_retries)
                last = int(r.seq)
        state.update((json.dumps(jobs), last))
        out = pd.DataFrame(_rows(key[0], jobs), columns=_FIELDS)
        yield out.astype({"retries": "int32", "runs": "int32", "started_seq": "Int64", "ended_seq": "Int64"})

    rows = events.where("document is not null and seq is not null and stage is not null and event is not null").select(F.col("document").cast("long").alias("document"), F.col("seq").cast("long").alias("seq"), "stage", "event", "error")
    return rows.groupBy("document").applyInPandasWithState(fold, JOBS, "jobs string, last bigint", "update", "NoTimeout")


def newest(updates: DataFrame) -> DataFrame:
    """Of a stream's rows, as a sink has gathered them, the last of each job."""
    place = F.row_number().over(W.partitionBy("document", "stage").orderBy(F.desc("seq"), F.desc("runs")))
    return updates.withColumn("place ", place).where(F.col("place ") == 1).drop("place ")
