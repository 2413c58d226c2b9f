"""Queries over state machines: crawled resources with their log, chains of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import crawl_state, dimensions, job_chains

from .book import query


def crawl_commands(t):
    """Commands made from all events: some 3 resources a user, five sources, and now and then a whole source is to wait."""
    e, n = F.col("event_type"), F.col("event_id")
    whole = n % 97 == 0
    action = F.when(whole, "stale_all").when(e == "click", "stale").when(e == "error", "failed").when((e == "purchase") & (n % 4 == 0), "purge").otherwise("upsert")
    status = F.when((action == "upsert") & (n % 11 == 0), F.element_at(F.array(*map(F.lit, ("fresh", "stale", "failed", "purged"))), (n % 4 + 1).cast("int")))
    path = F.concat_ws("/", F.col("user_id").cast("string"), (n % 3).cast("string"))
    return t.events.select(
        n.alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), F.when(~whole, path).alias("path"), action.alias("action"), F.concat(F.lit("r"), n.cast("string")).alias("resource_id"),
        F.col("ts").cast("string").alias("modified"), F.md5(F.col("props")).alias("content_hash"), (n % 50).cast("int").alias("chunk_count"), status.alias("status"), F.when(e == "error", F.col("props")).alias("error"),
    )


_COMMANDS = """c AS (
    SELECT *, CASE WHEN action = 'upsert' AND seq % 11 = 0 THEN ['fresh', 'stale', 'failed', 'purged'][seq % 4 + 1] END AS status FROM (
        SELECT event_id AS seq, ts AS moment, 'src' || (user_id % 5) AS source, CASE WHEN event_id % 97 > 0 THEN user_id || '/' || (event_id % 3) END AS path,
            CASE WHEN event_id % 97 = 0 THEN 'stale_all' WHEN event_type = 'click' THEN 'stale' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'purge' ELSE 'upsert' END AS action,
            (event_id % 50)::INTEGER AS chunks, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
), lines AS (
    SELECT c.*, row_number() OVER (PARTITION BY source, path ORDER BY seq) AS n FROM (
        SELECT * FROM c WHERE path IS NOT NULL UNION ALL SELECT a.seq, a.moment, a.source, p.path, a.action, a.chunks, a.error, a.status FROM c a JOIN (SELECT DISTINCT source, path FROM c WHERE path IS NOT NULL) p USING (source) WHERE a.path IS NULL) c
), f AS (
    SELECT source, path, 0::BIGINT AS n, NULL::BIGINT AS seq, '' AS action, NULL::VARCHAR AS status, NULL::BIGINT AS upsert, NULL::INTEGER AS chunks, NULL::VARCHAR AS error, NULL::TIMESTAMP AS moment FROM (SELECT DISTINCT source, path FROM lines)
    UNION ALL
    SELECT f.source, f.path, l.n, l.seq, l.action, CASE WHEN l.action = 'upsert' THEN coalesce(l.status, 'fresh') WHEN f.upsert IS NULL THEN NULL WHEN l.action = 'purge' THEN 'purged' WHEN l.action = 'stale_all' AND f.status = 'purged' THEN f.status
            WHEN l.action = 'failed' THEN 'failed' ELSE 'stale' END,
        CASE WHEN l.action = 'upsert' THEN l.seq ELSE f.upsert END, CASE WHEN l.action = 'upsert' THEN l.chunks WHEN f.upsert IS NOT NULL AND l.action = 'purge' THEN 0 ELSE f.chunks END,
        CASE WHEN l.action = 'upsert' OR (l.action = 'failed' AND f.upsert IS NOT NULL) THEN l.error ELSE f.error END,
        CASE WHEN l.action <> 'upsert' AND (f.upsert IS NULL OR (l.action = 'stale_all' AND f.status = 'purged')) THEN f.moment ELSE l.moment END
    FROM f JOIN lines l ON l.source = f.source AND l.path = f.path AND l.n = f.n + 1
)"""


@query(f"""WITH RECURSIVE {_COMMANDS} SELECT f.source, f.path, 'r' || f.upsert AS resource_id, md5(e.props) AS content_hash, f.chunks AS chunk_count, f.status, f.error, f.moment AS indexed_at
FROM f JOIN (SELECT source, path, max(n) AS n FROM f GROUP BY 1, 2) m ON m.source = f.source AND m.path = f.path AND m.n = f.n JOIN events e ON e.event_id = f.upsert""")
def crawl_states(t):
    """Resources after all commands, kept in three batches that come out of order."""
    commands = crawl_commands(t)
    batch = lambda k: commands.where(F.pmod(F.col("seq"), F.lit(3)) == k)
    kept = crawl_state.after(crawl_state.after(crawl_state.kept(batch(2)), batch(0)), batch(1))
    return crawl_state.state(kept).drop("modified")


@query(f"""WITH RECURSIVE {_COMMANDS}, born AS (SELECT source, path, min(seq) AS born FROM c WHERE action = 'upsert' GROUP BY 1, 2)
SELECT seq, c.source, c.path, CASE WHEN action = 'upsert' THEN CASE WHEN coalesce(status, 'fresh') = 'fresh' THEN 'added' ELSE status END WHEN action = 'purge' THEN 'purged' ELSE action END AS action, error AS detail
    FROM c LEFT JOIN born b ON b.source = c.source AND b.path = c.path WHERE c.path IS NOT NULL AND (action IN ('upsert', 'failed') OR born < seq)
UNION ALL SELECT c.seq, c.source, NULL, 'stale_all', 'queued ' || (SELECT count(*) FROM f WHERE f.seq = c.seq AND f.source = c.source AND f.upsert IS NOT NULL AND f.status <> 'purged') FROM c WHERE path IS NULL""")
def crawl_log(t):
    return crawl_state.log(crawl_commands(t)).select("seq", "source", "path", "action", "detail")


def job_events(t):
    e, n = F.col("event_type"), F.col("event_id")
    stage = F.when((e == "signup") | (n % 3 > 0), "capture").otherwise("convert")
    event = F.when(e == "signup", "enqueue").when(e == "click", "complete").when(e == "error", "fail").otherwise("start")
    return t.events.select(F.col("user_id").alias("document"), n.alias("seq"), stage.alias("stage"), event.alias("event"), F.when(e == "error", F.col("props")).alias("error"))


def _job_sql(name: str, enqueued: str) -> str:
    """The next state of one job, a struct; ``enqueued`` says when it is to be put in line."""
    new = lambda status, r="j.r", e="j.e", ss="j.ss", es="j.es", runs="j.runs": f"{{'st': {status}, 'r': {r}, 'e': {e}, 'ss': {ss}, 'es': {es}, 'runs': {runs}, 'seq': v.seq}}".replace("j.", f"f.{name}.")
    open_ = f"f.{name}.st IN ('pending', 'running')"
    own = f"v.stage = '{name}' AND {open_}"
    nothing = "NULL::BIGINT"
    return f"""CASE WHEN ({enqueued}) AND NOT ({open_}) THEN {new("'pending'", "0", "NULL::VARCHAR", nothing, nothing, "j.runs + 1")} WHEN {own} AND v.event = 'start' THEN {new("'running'", ss="v.seq")}
        WHEN {own} AND v.event = 'complete' THEN {new("'completed'", es="v.seq")} WHEN {own} AND v.event = 'fail' AND f.{name}.r < 2 THEN {new("'pending'", "j.r + 1", "v.error")}
        WHEN {own} AND v.event = 'fail' THEN {new("'failed'", e="v.error", es="v.seq")} ELSE f.{name} END AS {name}"""


_NO_JOB = "{'st': '', 'r': 0, 'e': NULL::VARCHAR, 'ss': NULL::BIGINT, 'es': NULL::BIGINT, 'runs': 0, 'seq': NULL::BIGINT}"


@query(f"""WITH RECURSIVE v AS (
    SELECT user_id AS document, event_id AS seq, CASE WHEN event_type = 'signup' OR event_id % 3 > 0 THEN 'capture' ELSE 'convert' END AS stage, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'start' END AS event,
        CASE WHEN event_type = 'error' THEN props END AS error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), f AS (
    SELECT DISTINCT document, 0::BIGINT AS n, {_NO_JOB} AS capture, {_NO_JOB} AS convert FROM v
    UNION ALL SELECT f.document, v.n, {_job_sql("capture", "v.stage = 'capture' AND v.event = 'enqueue'")}, {_job_sql("convert", "v.stage = 'capture' AND v.event = 'complete' AND f.capture.st IN ('pending', 'running')")}
    FROM f JOIN v ON v.document = f.document AND v.n = f.n + 1
), ends AS (SELECT f.* FROM f JOIN (SELECT document, max(n) AS n FROM f GROUP BY 1) m USING (document, n)
), jobs AS (SELECT document, 'capture' AS stage, capture AS j FROM ends UNION ALL SELECT document, 'convert', convert FROM ends)
SELECT document, stage, j.st AS status, j.r AS retries, j.e AS error, j.ss AS started_seq, j.es AS ended_seq, j.runs AS runs, j.seq AS seq FROM jobs WHERE j.st <> ''""")
def chained_jobs(t):
    """Jobs of all documents after their events: starts, ends, retries, and the stages that follow."""
    return job_chains.folded(job_events(t), max_retries=2)


#: Lines that one task joins with their orders, and adds up by topic before they move on.
SHARE = 1 << 18


def dimension_facts(t):
    """(systems, facts, judged): customers as systems, their orders as conflicts, lines of the orders as edges.

    Lines meet their orders in a task for each ``SHARE`` of them, so that tasks get no larger as lines get more.
    """
    tasks = max(1, -(-t.lineitem.count() // SHARE))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).repartition(tasks, "o_orderkey")
    system = F.col("c_name").alias("system")
    grade = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "odd"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    verdict = F.when(F.col("o_orderkey") % 5 > 0, F.element_at(F.array(*map(F.lit, ("confirmed", "uncertain", "rejected", "confirmed"))), (F.col("o_orderkey") % 5).cast("int")))
    conflicts = o.select(system, F.lit("conflict").alias("dimension"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("topic"), grade.alias("grade"), verdict.alias("verdict"))
    strength = F.element_at(F.array(*map(F.lit, ("strong", "weak", "loose"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    edges = t.lineitem.repartition(tasks, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(system, F.lit("hub").alias("dimension"), F.lit("edge").alias("kind"), F.col("l_partkey").cast("string").alias("topic"), strength.alias("grade"), F.lit(None).cast("string").alias("verdict"))
    judged = t.customer.where("c_custkey % 50 = 0").select(system, (F.col("c_custkey") / 50).cast("int").alias("place"), F.lit("A").alias("grade"), F.col("c_mktsegment").alias("rationale"))
    return t.customer.select(system), conflicts.unionByName(edges), judged


@query("""WITH f AS (
    SELECT c_name AS system, 'conflict' AS dimension, o_orderstatus AS kind, o_orderpriority AS topic, [3.0, 1.5, 0.7, 0.5][o_orderkey % 4 + 1]::DOUBLE AS w, o_orderkey % 5 <> 3 AS ok FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT c_name, 'hub', 'edge', l_partkey::VARCHAR, [1.5, 1.0, 0.5][l_linenumber % 3 + 1]::DOUBLE, true FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
), topics AS (SELECT system, dimension, kind, topic, CASE dimension WHEN 'conflict' THEN max(w) FILTER (ok) ELSE sum(w) END AS w FROM f GROUP BY system, dimension, kind, topic
), raw AS (SELECT system, dimension, sum(coalesce(w, 0)) AS raw FROM topics GROUP BY system, dimension
), s AS (SELECT c_name AS system, d.dimension AS dimension, round_even(coalesce(raw.raw, 0), 9) AS raw FROM customer CROSS JOIN (VALUES ('conflict'), ('hub')) d(dimension) LEFT JOIN raw ON raw.system = c_name AND raw.dimension = d.dimension
), v AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY dimension) > 0 THEN round_even(raw * 10.0 / max(raw) OVER (PARTITION BY dimension), 2) ELSE 0 END AS value FROM s
), t AS (SELECT system, round_even(sum(value), 2) AS total, max(value) FILTER (dimension = 'conflict') AS conflict, max(value) FILTER (dimension = 'hub') AS hub FROM v GROUP BY 1
), j AS (SELECT c_name AS system, (c_custkey // 50)::INTEGER AS place, 'A' AS grade, c_mktsegment AS rationale FROM customer WHERE c_custkey % 50 = 0)
SELECT row_number() OVER (ORDER BY place IS NULL, place, total DESC, t.system) AS rank, t.system, total, conflict, hub, grade, rationale FROM t LEFT JOIN j ON j.system = t.system""")
def ranked_systems(t):
    """Both dimensions of all systems in one chain; the hub's part is run again and put in place of what was there."""
    systems, facts, judged = dimension_facts(t)
    both = dimensions.scores(systems, facts, ["conflict", "hub"])
    again = dimensions.replaced(both.withColumn("value", F.when(F.col("dimension") == "hub", -1.0).otherwise(F.col("value"))), dimensions.scores(systems, facts, ["hub"]))
    out = dimensions.ranked(again, judged)
    return out.select("rank", "system", "total", F.col("values")["conflict"].alias("conflict"), F.col("values")["hub"].alias("hub"), "grade", "rationale")
