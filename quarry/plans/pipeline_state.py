"""Queries of change detection, jobs, versions, logs and evaluation, over the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import evaluation
from quarry.operators import change, events, graph, joins, ranking, state
from quarry.operators.components import connected_components

from .book import query

_NOW = "TIMESTAMP '2024-01-31 03:30:00'"
_OLD = "o_orderdate < TIMESTAMP '1998-06-01'"


def _now():
    return F.expr(_NOW)


def _states(t):
    """A customer's newest order before a day, and from it on: what was stored, and what a crawl found."""
    of = lambda rows: rows.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("mark"), F.count(F.lit(1)).alias("n"))
    return of(t.orders.where(_OLD)), of(t.orders.where(f"not ({_OLD})"))


_STATES_SQL = f"""a AS (SELECT o_custkey AS key, max(o_orderkey) AS mark, count(*) AS n FROM orders WHERE {_OLD} GROUP BY 1),
b AS (SELECT o_custkey AS key, max(o_orderkey) AS mark, count(*) AS n FROM orders WHERE NOT ({_OLD}) GROUP BY 1)"""


@query(f"""WITH {_STATES_SQL} SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'deleted' WHEN a.mark IS NOT DISTINCT FROM b.mark THEN 'unchanged' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.key = b.key""")
def change_classification(t):
    return change.classify(*_states(t), key="key", mark="mark")


@query("""WITH a AS (SELECT sha256(text) AS key, min(doc_id) AS mark FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT sha256(text) AS key, min(doc_id) AS mark FROM documents WHERE source <> 'src1' GROUP BY 1)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'deleted' WHEN a.mark = b.mark THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key) GROUP BY change""")
def change_by_content_hash(t):
    of = lambda rows: rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("mark"))
    found = change.classify(of(t.documents.where("lang = 'en'")), of(t.documents.where("source <> 'src1'")), "key", "mark")
    return found.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STATES_SQL} SELECT coalesce(a.key, b.key) AS key, coalesce(b.mark, a.mark) AS mark, coalesce(b.n, a.n) AS n FROM a FULL JOIN b ON a.key = b.key")
def upsert(t):
    return change.upsert(*_states(t), key="key")


@query(f"WITH {_STATES_SQL} SELECT b.key, CASE WHEN a.key IS NULL THEN 'new' WHEN b.n > a.n THEN 'changed' ELSE 'unchanged' END AS change FROM b LEFT JOIN a ON a.key = b.key")
def newer_versions(t):
    return change.newer_versions(*_states(t), key="key", version="n")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def not_queued(t):
    jobs = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_returnflag") == "R", "running").otherwise("completed").alias("status"))
    return change.not_queued(t.supplier, jobs, "s_suppkey").select("s_suppkey", "s_name")


@query(f"WITH {_STATES_SQL} SELECT a.key FROM a LEFT JOIN b ON a.key = b.key WHERE b.key IS NULL OR a.mark > b.mark")
def stale_outputs(t):
    return change.stale_outputs(*_states(t), key="key", time="mark").select("key")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def cascade_delete(t):
    regions = t.region.where("r_name = 'ASIA'")
    nations = change.cascade(regions, t.nation, "r_regionkey", "n_regionkey")
    return change.cascade(nations, t.customer, "n_nationkey", "c_nationkey").select("c_custkey")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS p FROM events) WHERE p = 1")
def latest_per_key(t):
    return change.latest(t.events, ["event_type", "user_id"], F.desc("ts"), "event_id").select("event_type", "user_id", "event_id")


def _jobs(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("assigned_at"), F.col("o_orderpriority").alias("job_type"), (F.col("o_custkey") % 3).cast("int").alias("retry_count"), F.lit(2).alias("max_retries"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("worker_id"), F.col("o_orderpriority").alias("worker_type"),
    )


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY left(o_orderpriority, 1), o_orderdate, o_orderkey LIMIT 20")
def next_jobs(t):
    return state.next_jobs(_jobs(t), ["1-URGENT"], 20).select("id")


@query("""WITH n AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY left(o_orderpriority, 1), o_orderdate, o_orderkey LIMIT 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM n) THEN 'assigned' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status FROM orders""")
def claim_job(t):
    return state.claim(_jobs(t), "w1", _now()).select("id", "status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'completed' END WHEN o_totalprice > 200000 THEN 'completed' WHEN o_custkey % 3 < 2 THEN 'pending' ELSE 'failed' END AS status,
CAST(o_custkey % 3 + CASE WHEN o_orderstatus = 'P' AND o_totalprice <= 200000 AND o_custkey % 3 < 2 THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM orders""")
def finish_jobs(t):
    results = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 200000).alias("ok"), F.lit("no").alias("message"))
    return state.finish(_jobs(t), results, _now()).select("id", "status", "retry_count")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-01-01') THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status FROM orders")
def reset_stale_jobs(t):
    return state.reset_stale(_jobs(t), F.expr("TIMESTAMP '2001-01-02'"), 86400).select("id", "status")


@query("SELECT source_id, id, status FROM (SELECT o_custkey AS source_id, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS p FROM orders) WHERE p = 1")
def newest_job_per_source(t):
    return state.newest_per_stage(_jobs(t), ["source_id"]).select("source_id", "id", "status")


def _versions(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("version")).agg(F.max((F.col("l_returnflag") == "N").cast("int")).alias("is_active"))


_VERSIONS_SQL = "v AS (SELECT l_partkey AS document_id, l_linenumber AS version, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS is_active FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_VERSIONS_SQL} SELECT document_id, CAST(max(version) + 1 AS INTEGER) AS next_version FROM v GROUP BY 1")
def next_version(t):
    return state.next_version(_versions(t), ["document_id"])


@query(f"WITH {_VERSIONS_SQL} SELECT document_id, max(version) AS version FROM v WHERE is_active = 1 GROUP BY 1")
def active_version(t):
    return state.active_versions(_versions(t), ["document_id"]).select("document_id", "version")


@query(f"WITH {_VERSIONS_SQL}, c AS (SELECT document_id, min(version) AS chosen FROM v WHERE version > 2 GROUP BY 1) SELECT v.document_id, version, CAST(CASE WHEN chosen IS NULL THEN is_active WHEN version = chosen THEN 1 ELSE 0 END AS INTEGER) AS is_active FROM v LEFT JOIN c ON v.document_id = c.document_id")
def roll_back_version(t):
    versions = _versions(t)
    chosen = versions.where("version > 2").groupBy("document_id").agg(F.min("version").alias("version"))
    return state.activate(versions, chosen, ["document_id"])


@query(f"SELECT user_id AS worker_id FROM events GROUP BY user_id HAVING max(ts) >= {_NOW} - INTERVAL 43200 SECOND")
def alive_workers(t):
    beats = t.events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("last_seen"))
    return state.alive(beats, _now(), 43200).select("worker_id")


@query(f"""WITH u AS (SELECT user_id, max(ts) AS last_run, CASE user_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'manual' END AS schedule FROM events GROUP BY user_id)
SELECT user_id FROM u WHERE (schedule = 'hourly' AND epoch({_NOW}) - floor(epoch(last_run)) >= 3600) OR (schedule = 'daily' AND epoch({_NOW}) - floor(epoch(last_run)) >= 72000)""")
def due_sources(t):
    kind = F.element_at(F.array(*map(F.lit, ("hourly", "daily", "weekly", "manual"))), (F.col("user_id") % 4 + 1).cast("int"))
    users = t.events.groupBy("user_id").agg(F.max("ts").alias("last_run")).withColumn("schedule", kind)
    return users.where(state.due(F.col("schedule"), F.col("last_run"), _now())).select("user_id")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def status_rollup(t):
    return t.orders.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], F.col("o_orderstatus"), F.col("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 50 OFFSET 100")
def job_page(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return events.page_at(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 100, 50).select("o_orderkey", "c_name", "n_name")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def keyset_page(t):
    return events.page_after(t.events, "event_id", 500, 200).select("event_id", "user_id", "event_type")


@query("SELECT r.event_id AS report_id, l.event_id AS log_id FROM events r JOIN events l ON r.user_id = l.user_id AND l.ts BETWEEN r.ts - INTERVAL 600 MINUTE AND r.ts WHERE r.event_type = 'error'")
def logs_before_errors(t):
    reports = t.events.where("event_type = 'error'").select(F.col("event_id").alias("report_id"), F.col("ts").alias("report_ts"), "user_id")
    logs = t.events.select(F.col("event_id").alias("log_id"), "ts", "user_id")
    return events.before_each(reports, logs, ["user_id"], F.lit(600), most=None, bucket_seconds=36000).select("report_id", "log_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY OR event_id IN (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000)")
def retained_reports(t):
    rows = t.events.withColumn("report_id", F.col("event_id"))
    return events.retained_reports(rows, F.expr("TIMESTAMP '2024-01-31'"), 7, 5000).select("event_id")


@query("SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS started, min(CASE WHEN event_type = 'purchase' THEN ts END) AS ended FROM events GROUP BY user_id HAVING started IS NOT NULL AND ended IS NOT NULL")
def paired_intervals(t):
    return events.paired(t.events, "user_id", "event_type", "signup", "purchase", "ts").select("user_id", "started", "ended")


@query("SELECT event_id, CAST(floor(epoch(n)) - floor(epoch(ts)) AS BIGINT) AS gap_seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE event_type = 'view'")
def gap_after_view(t):
    return events.gap_to_next(t.events, ["user_id"], "event_type", "view", "ts", ["ts", "event_id"]).select("event_id", "gap_seconds")


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) > 21600 THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY 1, 2""")
def sessions(t):
    return events.sessions(t.events, ["user_id"], "ts", 21600, ["ts", "event_id"]).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id")
def counts_per_user(t):
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("c_custkey")).agg(F.count(F.lit(1)).alias(name))
    out = t.customer.select("c_custkey").join(count(t.orders, "o_custkey", "orders"), "c_custkey", "left").join(count(t.events, "user_id", "events"), "c_custkey", "left")
    return out.na.fill(0, ["orders", "events"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 3")
def last_turns(t):
    return ranking.top_per(t.conversations, ["conv_id"], 3, F.desc("turn")).select("conv_id", "turn", "role")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS p FROM lineitem) ORDER BY p > 5, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 300")
def capped_per_supplier(t):
    return ranking.capped_first(t.lineitem, "l_suppkey", 5, 300, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents) ORDER BY p > 20, n_chars DESC, doc_id LIMIT 100")
def quota_per_source(t):
    return ranking.with_quota(t.documents, "source", 100, F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "source")


@query("""WITH x AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents)
SELECT source, doc_id FROM x WHERE total <= 40000""")
def token_budget(t):
    return ranking.within_budget(t.documents, ["source"], "n_chars", 40000, "-n_chars", "doc_id").select("source", "doc_id")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS c, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents WHERE n_chars <= 30000),
w AS (SELECT DISTINCT source, 0::BIGINT AS p, 0::BIGINT AS used, NULL::BIGINT AS doc_id, false AS took FROM r
UNION ALL SELECT w.source, r.p, CASE WHEN used + c <= 30000 THEN used + c ELSE used END, r.doc_id, used + c <= 30000 FROM w JOIN r ON r.source IS NOT DISTINCT FROM w.source AND r.p = w.p + 1)
SELECT source, doc_id FROM w WHERE took""")
def skipping_budget(t):
    return ranking.skipping_budget(t.documents, ["source"], "doc_id", "n_chars", 30000, "n_chars")


@query("WITH x AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT s_nationkey, round_even(n * 10.0 / (SELECT max(n) FROM x), 2) AS score FROM x")
def max_normalised(t):
    return ranking.scaled_to_ten(t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), "n", "score").select("s_nationkey", "score")


@query("SELECT lang, list_sort(list(n_chars))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(n_chars))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90, CAST(floor(sum(n_chars) / count(*)) AS BIGINT) AS mean_down FROM documents GROUP BY lang")
def picked_percentiles(t):
    return ranking.picked_percentiles(t.documents, ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9})


@query("SELECT l_suppkey AS system, sum(w) AS raw, count(*) AS topics FROM (SELECT l_suppkey, l_returnflag, l_linenumber, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def topic_weights(t):
    rows = t.lineitem.withColumnRenamed("l_suppkey", "system")
    return ranking.topic_sum(rows, "system", "l_returnflag", "l_linenumber", "l_quantity")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS p FROM documents) WHERE p <= 10")
def stratified_sample(t):
    return ranking.stratified(t.documents, "source", 10, "doc_id").select("doc_id", "source")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents) ORDER BY p > CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 30 ELSE 0 END, doc_id LIMIT 100")
def balanced_sample(t):
    return ranking.balanced(t.documents, "lang", {"en": 0.4, "de": 0.3}, 100, F.asc("doc_id")).select("doc_id", "lang")


@query("WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT a.l_suppkey, a.q AS q_before, b.q AS q_after, CASE WHEN b.q > a.q THEN 'up' WHEN b.q < a.q THEN 'down' ELSE 'same' END AS q_arrow FROM a JOIN b ON a.l_suppkey = b.l_suppkey")
def compare_runs(t):
    of = lambda s: t.lineitem.where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return joins.compared(of("F"), of("O"), "l_suppkey", ["q"]).drop("q_percent")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT user_id AS k FROM events) SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS left_only, count(*) FILTER (WHERE a.k IS NULL) AS right_only FROM a FULL JOIN b ON a.k = b.k""")
def overlap_of_ids(t):
    return joins.overlap(t.customer.select(F.col("c_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k").drop("percent_of_left")


@query("""WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS "left", b.x AS "right", CAST(levenshtein(a.x, b.x) AS INTEGER) AS distance FROM n a JOIN n b ON left(a.x, 3) = left(b.x, 3) AND a.x <> b.x AND abs(length(a.x) - length(b.x)) <= 3)
SELECT "left", "right", distance FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY distance, "right") AS r FROM p WHERE distance <= 3) WHERE r <= 5""")
def fuzzy_names(t):
    return joins.fuzzy(t.part, t.part, "p_name", "p_name")


@query("SELECT DISTINCT w.p_word AS word, p.p_name FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS p_word FROM part) w JOIN (SELECT DISTINCT p_name FROM part) p ON list_contains(string_split(p.p_name, ' '), w.p_word)")
def names_in_names(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return joins.containing(words, t.part.select("p_name").distinct(), "word", "p_name", "p_name")


def _edges(t):
    return graph.symmetric(t.nation.select(F.col("n_name").alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst")))


_EDGES_SQL = "e AS (SELECT n_name AS src, 'R' || n_regionkey AS dst FROM nation UNION SELECT 'R' || n_regionkey, n_name FROM nation)"


@query(f"WITH {_EDGES_SQL} SELECT src, dst FROM e")
def symmetric_edges(t):
    return _edges(t)


@query(f"""WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT DISTINCT src AS start, src AS node, 0 AS distance FROM e UNION SELECT r.start, e.dst, r.distance + 1 FROM r JOIN e ON r.node = e.src WHERE r.distance < 2) SELECT start, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY 1, 2""")
def neighbours_within_two(t):
    return graph.within(_edges(t), _edges(t).select(F.col("src").alias("node")), 2)


@query("SELECT CAST(l_suppkey AS BIGINT) AS node, count(*) AS degree, sum(q) AS weighted_degree FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def weighted_degree(t):
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    return graph.degrees(edges, "q")


@query(f"WITH {_EDGES_SQL} SELECT src AS node, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_hubs(t):
    return graph.hubs(_edges(t), 5)


@query("SELECT n_name AS node, min(n_name) OVER (PARTITION BY n_regionkey) AS component FROM nation UNION SELECT 'R' || n_regionkey, min(n_name) OVER (PARTITION BY n_regionkey) FROM nation")
def components(t):
    return connected_components(_edges(t))


@query("SELECT 'N' || n_nationkey AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R' || r_regionkey, r_name FROM region")
def tree_paths(t):
    regions = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), "n_name")
    return graph.paths_to_root(regions.union(nations), "id", "parent", "name")


@query("SELECT lang AS category, round_even(avg(CASE WHEN source = 'src0' THEN quality END) * 100, 1) AS src0, round_even(avg(CASE WHEN source = 'src1' THEN quality END) * 100, 1) AS src1 FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (WHERE source IN ('src0', 'src1')) >= 0")
def pass_rates(t):
    rows = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("strategy"), (F.col("quality") == 1).alias("passed"))
    return evaluation.pass_rates(rows, ["src0", "src1"])


@query("SELECT source AS case_id FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING NOT bool_or(toxic = 1)")
def never_toxic_sources(t):
    rows = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("case_id"), (F.col("toxic") == 1).alias("passed"))
    return evaluation.never_passed(rows)


@query("SELECT count(*) AS cases, count(*) AS eligible, count(*) FILTER (WHERE quality = 1) AS passed, CAST(sum(n_chars) AS BIGINT) AS tool_calls FROM documents JOIN labels USING (doc_id)")
def run_totals(t):
    rows = t.documents.join(t.labels, "doc_id").select((F.col("quality") == 1).alias("passed"), F.lit(1.0).alias("seconds"), F.col("n_chars").alias("tool_calls"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("error"), F.col("n_chars").alias("answer_length"))
    return evaluation.run_totals(rows).select("cases", "eligible", "passed", "tool_calls")


@query("""WITH r AS (SELECT l_suppkey AS case_id, l_returnflag AS target, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT case_id, CAST(max(CASE WHEN target = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS hit, round_even(sum(CASE WHEN target = 'A' THEN 1 ELSE 0 END) / count(*), 6) AS precision FROM r WHERE rank <= 3 GROUP BY 1""")
def hits_at_three(t):
    results = ranking.top_per(t.lineitem, ["l_suppkey"], 3, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("target"), "rank")
    expected = t.lineitem.select(F.col("l_suppkey").alias("case_id"), F.lit("A").alias("target")).distinct()
    return evaluation.hits(results, expected, 3)


@query("SELECT 'DEC-' || lpad(CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER)) + 1 AS VARCHAR), 4, '0') AS next_id FROM customer")
def next_id(t):
    return evaluation.next_id(t.customer.select(F.concat(F.lit("DEC-"), F.regexp_extract("c_name", r"0*(\d+)$", 1)).alias("c")), "c", "DEC-")


@query("SELECT source, lang FROM documents WHERE quality_missing GROUP BY 1, 2".replace("WHERE quality_missing", "WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def except_labelled(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id")).join(t.documents, "doc_id").select("source", "lang").distinct()
