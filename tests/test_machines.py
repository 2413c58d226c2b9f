import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import crawl_state as crawl
from quarry.operators import job_chains as jobs
from quarry.plans.book import Tables
from quarry.plans.machines import crawl_commands, job_events

T0 = dt.datetime(2024, 1, 1)
COMMANDS = "seq long, at timestamp, source string, path string, action string, resource_id string, modified string, content_hash string, chunk_count int, status string, error string"


def random_commands(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        action = r.choice(["upsert"] * 4 + ["purge", "stale", "failed", "stale_all", "nonsense"])
        status = r.choice([None, "fresh", "stale", "purged", "failed"]) if action == "upsert" else None
        out.append((i, T0 + dt.timedelta(seconds=i), r.choice(["a", "b", None]), None if action == "stale_all" or r.random() < 0.05 else f"p{r.randrange(6)}", action, f"r{i}", str(i), f"h{i % 7}", r.choice([None, 3]), status, r.choice([None, "e" * 600, "x"])))
    return out


def run(commands):
    """The commands one by one over a dictionary: (state, log)."""
    state, log = {}, []
    for seq, at, source, path, action, resource, modified, digest, chunks, status, error in sorted(commands, key=lambda c: c[0]):
        cut = None if error is None else error[:500]
        if source is None or (path is None and action != "stale_all"):
            continue
        if action == "upsert":
            state[source, path] = [resource, modified, digest, chunks or 0, status or "fresh", cut, at]
            log.append((seq, source, path, "added" if (status or "fresh") == "fresh" else status, error))
        elif action == "stale_all":
            hit = [s for (src, _), s in state.items() if src == source and s[4] != "purged"]
            for s in hit:
                s[4], s[6] = "stale", at
            log.append((seq, source, None, "stale_all", f"queued {len(hit)}"))
        elif action in ("purge", "stale", "failed"):
            known = state.get((source, path))
            if known:
                known[4], known[6] = {"purge": "purged"}.get(action, action), at
                if action == "purge":
                    known[3] = 0
                if action == "failed":
                    known[5] = cut
            if known or action == "failed":
                log.append((seq, source, path, {"purge": "purged"}.get(action, action), error))
    return {k: tuple(v) for k, v in state.items()}, sorted(log)


def of(state):
    return {(r.source, r.path): (r.resource_id, r.modified, r.content_hash, r.chunk_count, r.status, r.error, r.indexed_at) for r in state.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_in_any_order_of_batches(spark, seed):
    rows = random_commands(300, seed)
    want, log = run(rows)
    df = spark.createDataFrame(rows, COMMANDS).repartition(3)
    assert of(crawl.state(crawl.kept(df))) == want
    batches = [spark.createDataFrame(rows[i::3], COMMANDS) for i in range(3)]
    for order in list(itertools.permutations(range(3)))[:: 2 if seed == 1 else 5]:
        kept = crawl.kept(batches[order[0]])
        for i in order[1:]:
            kept = crawl.after(kept, batches[i])
        assert of(crawl.state(crawl.after(kept, batches[order[0]]))) == want  # the first one comes twice
    entries = crawl.log(df.unionByName(df))
    assert sorted((r.seq, r.source, r.path, r.action, r.detail) for r in entries.collect()) == log


@pytest.mark.parametrize("seed", [1, 3])
def test_the_log_gives_the_state(spark, seed):
    df = spark.createDataFrame(random_commands(250, seed), COMMANDS)
    replayed = crawl.state(crawl.kept(crawl.commands_of(crawl.log(df))))
    assert of(replayed) == of(crawl.state(crawl.kept(df)))


def test_replay_over_all_events(spark, sf_dir):
    commands = crawl_commands(Tables(spark, sf_dir))
    assert of(crawl.state(crawl.kept(crawl.commands_of(crawl.log(commands))))) == of(crawl.state(crawl.kept(commands)))


def test_no_commands(spark):
    none = spark.createDataFrame([], COMMANDS)
    assert crawl.state(crawl.kept(none)).count() == 0 and crawl.log(none).count() == 0


EVENTS = "document long, seq long, stage string, event string, error string"


def test_one_chain(spark):
    steps = [("capture", "start"), ("capture", "enqueue"), ("capture", "enqueue"), ("capture", "start"), ("capture", "fail"), ("capture", "fail"), ("convert", "start"), ("capture", "start"), ("capture", "complete"), ("capture", "complete"),
             ("convert", "start"), ("convert", "fail"), ("convert", "fail"), ("convert", "fail"), ("convert", "complete"), ("capture", "enqueue"), ("other", "enqueue"), ("other", "complete")]
    rows = [(1, i, stage, event, f"e{i}" if event == "fail" else None) for i, (stage, event) in enumerate(steps)]
    rows += [(1, 3, "capture", "start", None), (None, 1, "capture", "enqueue", None), (2, None, "capture", "enqueue", None), (3, 1, "capture", None, None), (4, 1, "capture", "complete", None)]
    got = {r.stage: tuple(r)[2:] for r in jobs.folded(spark.createDataFrame(rows, EVENTS).repartition(4), max_retries=2).collect()}
    assert got == {
        "capture": ("pending", 0, None, None, None, 2, 15),
        "convert": ("failed", 2, "e13", 10, 13, 1, 13),
        "other": ("completed", 0, None, None, 17, 1, 17),
    }
    assert jobs.folded(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_and_batch_give_one_table(spark, sf_dir, tmp_path):
    events = job_events(Tables(spark, sf_dir)).cache()
    edges = events.agg(F.percentile("seq", [0.3, 0.7])).first()[0]
    parts = [events.where(F.col("seq") <= edges[0]), events.where((F.col("seq") > edges[0]) & (F.col("seq") <= edges[1])), events.where(F.col("seq") > edges[1] - 20)]  # the last one brings known events again
    (tmp_path / "in").mkdir()
    stream = jobs.streamed(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), max_retries=2)
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        sink = lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = sorted(map(tuple, jobs.newest(spark.read.parquet(f"{tmp_path}/out")).collect()), key=str)
    assert got and got == sorted(map(tuple, jobs.folded(events, max_retries=2).collect()), key=str)
