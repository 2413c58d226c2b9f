import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import change, events, graph, joins, ranking, state

T0 = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_classify(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, m string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, None), (5, "e"), (3, None)], "k int, m string")
    got = {r.k: r.change for r in change.classify(old, new, "k", "m").collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "unchanged", 5: "new"}
    assert {r.k: r.change for r in change.classify(old, new.where("k = 5"), "k", "m").collect()}[1] == "deleted"
    assert [r.k for r in change.classify(old, new.where("k = 5"), "k", "m", full=False).collect()] == [5]


def test_upsert_twice_is_once(spark):
    have = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "k int, v string, l array<string>")
    got = spark.createDataFrame([(2, None, ["z"]), (3, "c", None)], "k int, v string, l array<string>")
    once = change.upsert_joining_lists(have, got, "k", ["l"])
    assert [tuple(r) for r in once.orderBy("k").collect()] == [(1, "a", ["x"]), (2, "b", ["y", "z"]), (3, "c", [])]
    assert sorted(map(str, change.upsert_joining_lists(once, got, "k", ["l"]).collect())) == sorted(map(str, once.collect()))


def test_orphans(spark):
    names = spark.createDataFrame([("Quest sys",), ("Q",), ("Other",)], "n string")
    titles = spark.createDataFrame([("Quest system overview",), ("Quest sys",), ("Zzz",)], "t string")
    got = {tuple(r) for r in change.orphans(names, titles, "n", "t").collect()}
    assert got == {("Quest sys", "Quest system overview"), ("Q", "Quest system overview"), ("Q", "Quest sys")}


def test_window_before_a_report(spark):
    """Of rows 3, 5 and 30 minutes before, a window of 10 minutes has the first two; a session must agree if it is named."""
    reports = spark.createDataFrame([(1, T0, "m1", "s1"), (2, T0, "m1", None)], "report_id int, report_ts timestamp, machine string, session string")
    logs = spark.createDataFrame([(1, at(-3), "m1", "s1"), (2, at(-5), "m1", "s2"), (3, at(-30), "m1", "s1"), (4, at(-1), "m2", "s1"), (5, at(1), "m1", "s1"), (6, at(-10), "m1", "s1"), (7, at(0), "m1", "s1")], "log_id int, ts timestamp, machine string, session string")
    found = events.before_each(reports, logs, ["machine", "session"], F.lit(10))
    assert sorted((r.report_id, r.log_id) for r in found.collect()) == [(1, 1), (1, 6), (1, 7), (2, 1), (2, 2), (2, 6), (2, 7)]
    newest = events.before_each(reports, logs, ["machine", "session"], F.lit(10), most=1)
    assert sorted((r.report_id, r.log_id) for r in newest.collect()) == [(1, 7), (2, 7)]


def test_valid_logs(spark):
    rows = [(T0, "app", "WARN", "a"), (None, "app", "loud", "b" * 9000), (T0, "other", "info", "c"), (T0, "app", None, "d"), (T0, "app", "info", None)]
    out = events.valid_logs(spark.createDataFrame(rows, "ts timestamp, source string, level string, message string"), F.lit(at(5)), ("app",)).collect()
    assert [(r.level, len(r.message)) for r in out] == [("warn", 1), ("info", 8000), ("info", 1)] and out[1].ts == at(5)


def test_retention(spark):
    rows = spark.createDataFrame([(i, T0 - dt.timedelta(days=d)) for i, d in enumerate((1, 29, 31, 40))], "report_id int, ts timestamp")
    assert [r.report_id for r in events.retained_logs(rows, F.lit(T0)).collect()] == [0, 1]
    assert sorted(r.report_id for r in events.retained_reports(rows, F.lit(T0), 30, newest=3).collect()) == [0, 1, 2]
    assert events.since("30m") == ("mins", 30) and events.since(" 2d ") == ("days", 2)
    with pytest.raises(ValueError, match="duration"):
        events.since("soon")
    assert events.after_cutoff(rows, "ts", F.lit(T0), "30d").count() == 2
    pages = spark.range(10)
    assert [r.id for r in events.page_after(pages, "id", 3, 2).collect()] == [4, 5] and events.page_after(pages, "id", None, 0).count() == 1


def test_schedules(spark):
    monday = dt.datetime(2024, 1, 8, 4)
    rows = [("manual", None), ("hourly", None), ("hourly", monday - dt.timedelta(minutes=59)), ("hourly", monday - dt.timedelta(minutes=60)), ("daily", monday - dt.timedelta(hours=21)), ("daily", monday - dt.timedelta(hours=19)), ("weekly", monday - dt.timedelta(days=6)), ("weekly", monday - dt.timedelta(days=5)), (None, None), ("yearly", monday)]
    df = spark.createDataFrame(rows, "s string, l timestamp")
    due = lambda now: [r.d for r in df.select(state.due(F.col("s"), F.col("l"), F.lit(now)).alias("d")).collect()]
    assert due(monday) == [False, True, False, True, True, False, True, False, False, False]
    assert due(monday.replace(hour=2))[4:8] == [False] * 4


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "pending", 2, at(0), "a"), (2, "pending", 1, at(5), "a"), (3, "pending", 1, at(4), "b"), (4, "running", 0, at(0), "a")], "id int, status string, priority int, created_at timestamp, worker_type string").withColumns({"worker_id": F.lit(None).cast("string"), "assigned_at": F.lit(None).cast("timestamp")})
    assert [r.id for r in state.next_jobs(jobs, n=9).collect()] == [3, 2, 1] and [r.id for r in state.next_jobs(jobs, ["a"]).collect()] == [2]
    after = {r.id: (r.status, r.worker_id) for r in state.claim(jobs, "w", F.lit(T0), ["a"]).collect()}
    assert after == {1: ("pending", None), 2: ("assigned", "w"), 3: ("pending", None), 4: ("running", None)}


def test_budgets(spark):
    rows = spark.createDataFrame([(i, float(10 - i), c) for i, c in enumerate((40, 70, 30, 30, 5))], "id int, score double, cost int")
    order = (F.desc("score"), F.asc("id"))
    assert [r.id for r in ranking.within_budget(rows, [], "cost", 100, *order).collect()] == [0]
    assert sorted(r.id for r in ranking.skipping_budget(rows, [], "id", "cost", 100, "score").collect()) == [0, 2, 3]
    assert [r.id for r in ranking.within_budget(rows, [], "cost", 1000, *order).collect()] == [0, 1, 2, 3, 4]


def test_budgets_of_hot_and_null_keys(spark):
    """Against folds: a hot key over many ranges, a null key, free and unpayable rows, ties."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", None]), rng.randrange(40), rng.choice([0, 1, 5, 30, 900])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, k string, score int, cost int").repartition(5)
    within, skipping = set(), set()
    for key in ("hot", "b", None):
        total = used = 0
        for i, _, _, cost in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0])):
            total += cost
            if total <= 700:
                within.add((key, i))
            if used + cost <= 700:
                used += cost
                skipping.add((key, i))
    order = (F.desc("score"), F.asc("id"))
    assert {(r.k, r.id) for r in ranking.within_budget(df, ["k"], "cost", 700, *order).collect()} == within
    assert sorted(map(str, map(tuple, ranking.skipping_budget(df, ["k"], "id", "cost", 700, "score").collect()))) == sorted(map(str, skipping))
    assert ranking.skipping_budget(df.where("false"), ["k"], "id", "cost", 700, "score").count() == 0
    values = sorted(r[2] for r in rows)
    one = ranking.picked_percentiles(df, [], "score", {"p50": 0.5, "p99": 0.99}).first()
    assert (one.p50, one.p99) == (values[600], values[1188])
    place = {}
    listed = sorted(rows, key=lambda r: (-r[2], r[0]))
    for i, key, *_ in listed:
        place[i] = sum(1 for j, k, *_ in listed if k == key and j in place)
    for limit in (4, 30, 2000):
        want = sorted(listed, key=lambda r: (place[r[0]] >= 6, -r[2], r[0]))[:limit]
        assert sorted(r.id for r in ranking.capped_first(df, "k", 6, limit, *order).collect()) == sorted(r[0] for r in want)
        quota = {"b": round(limit * 0.3)}
        want = sorted(listed, key=lambda r: (place[r[0]] >= quota.get(r[1], 0), -r[2], r[0]))[:limit]
        assert sorted(r.id for r in ranking.balanced(df, "k", {"b": 0.3}, limit, *order).collect()) == sorted(r[0] for r in want)


def test_percentiles_and_quotas(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7)], "k string, v int")
    got = {r.k: (r.p50, r.p90, r.mean_down) for r in ranking.picked_percentiles(rows, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (3, 4, 2), "b": (7, 7, 7)}
    hits = spark.createDataFrame([(i, "x" if i < 20 else "y", float(100 - i)) for i in range(30)], "id int, kind string, score double")
    kinds = [r.kind for r in ranking.with_quota(hits, "kind", 10, F.desc("score"), F.asc("id")).collect()]
    assert kinds == ["x"] * 5 + ["y"] * 5
    assert {r.s for r in ranking.scaled_to_ten(spark.createDataFrame([(0.0,), (-1.0,)], "v double"), "v", "s").collect()} == {0.0}


@pytest.mark.parametrize("size", [2, 3])
def test_clusters_as_if_one_by_one(spark, size):
    rng = random.Random(size)
    near = {}
    for a, b in [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(0, x) for x in range(30, 60)]:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    turn = lambda x: (-len(near[x]), x)
    used, want = set(), []
    for node in sorted(near, key=turn):
        free = sorted(near[node] - used, key=turn)
        if node not in used and free:
            want.append([node, *free[: size - 1]])
            used |= set(want[-1])
    edges = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long")
    assert [r.nodes for r in graph.greedy_clusters(edges, 1000, size).orderBy("rank").collect()] == want
    assert [r.nodes for r in graph.greedy_clusters(edges, 4, size).orderBy("rank").collect()] == want[:4]
    assert graph.greedy_clusters(edges.where("false"), 4, size).count() == 0


def test_graph(spark):
    edges = graph.symmetric(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "a")], "src string, dst string"))
    assert edges.count() == 6 and edges.exceptAll(edges.select("dst", "src")).count() == 0
    got = {r.node: r.distance for r in graph.within(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert [tuple(r) for r in graph.greedy_clusters(edges, 5).collect()] == [(1, ["b", "c", "a"])]
    refs = spark.createDataFrame([("Skill Tree",), ("pk_quest",), ("none",)], "ref string")
    nodes = spark.createDataFrame([("skilltree",), ("PK_Quest",), ("Design/Quest",)], "node string")
    assert {(r.ref, r.node) for r in graph.resolve_names(refs, nodes).collect()} == {("Skill Tree", "skilltree"), ("pk_quest", "PK_Quest")}
    loop = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "id int, up int, name string")
    assert {(r.id, r.path) for r in graph.paths_to_root(loop, "id", "up", "name", most=5).collect()} == {(1, "r"), (2, "r/a"), (3, "r/a/b")}


def test_likeness(spark):
    a = spark.createDataFrame([("quest system",), ("Skill",), ("ab",)], "n string")
    b = spark.createDataFrame([("Quest  System",), ("skills",), ("skill tree of all",), ("AB",)], "m string")
    assert {(r.left, r.right): round(r.ratio, 2) for r in joins.alike(a, b, "n", "m").collect()} == {("quest system", "Quest  System"): 1.0, ("Skill", "skills"): 0.83, ("ab", "AB"): 1.0}
    texts = spark.createDataFrame([(1, "The Skill, tree"), (2, "skilled"), (3, "a b quest system x")], "id int, t string")
    assert {(r.n, r.id) for r in joins.containing(a, texts, "n", "id", "t").collect()} == {("Skill", 1), ("quest system", 3)}
    first = joins.first_match(spark.createDataFrame([("p1", "w"), ("p9", "w"), ("p9", "z")], "path string, book string"), [(spark.createDataFrame([("p1", 1)], "path string, doc int"), ["path"]), (spark.createDataFrame([("w", 2)], "book string, doc int"), ["book"])], "doc")
    assert {(r.path, r.book): r.doc for r in first.collect()} == {("p1", "w"): 1, ("p9", "w"): 2, ("p9", "z"): None}
    runs = joins.compared(spark.createDataFrame([(1, 10.0), (2, 0.0), (3, 1.0)], "id int, s double"), spark.createDataFrame([(1, 12.5), (2, 1.0)], "id int, s double"), "id", ["s"])
    assert {(r.id, r.s_percent, r.s_arrow) for r in runs.collect()} == {(1, 25.0, "up"), (2, None, "n/a")}
