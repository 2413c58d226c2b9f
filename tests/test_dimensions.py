from collections import defaultdict

from quarry.operators import dimensions

FACTS = "system string, dimension string, kind string, topic string, grade string, verdict string"
ROWS = [
    ("a", "conflict", "number", "t1", "high", "confirmed"), ("a", "conflict", "number", "t1", "low", None), ("a", "conflict", "word", "t1", "medium", "uncertain"), ("a", "conflict", "word", "t2", "high", "rejected"), ("a", "conflict", "word", "t3", None, None),
    ("a", "hub", "edge", "b", "strong", None), ("a", "hub", "edge", "b", "strong", None), ("a", "hub", "edge", "c", "loose", None), ("b", "hub", "edge", "a", "weak", None), ("b", "conflict", "x", None, "odd", "confirmed"),
    ("unasked", "hub", "edge", "a", "strong", None), ("c", "other", "x", "y", "high", None), (None, "hub", "edge", "a", "strong", None), ("b", "hub", "edge", None, "nothing", None),
]


def of(df):
    return {(r.system, r.dimension): (r.raw, r.value, r.facts, r.counted, r.topics) for r in df.collect()}


def test_scores(spark):
    systems = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 1), (None, 4)], "system string, raw int")
    facts = spark.createDataFrame([(*r, "x") for r in ROWS], f"{FACTS}, raw string").repartition(3)
    want = {
        ("a", "conflict"): (5.0, 10.0, 5, 4, 3), ("b", "conflict"): (0.5, 1.0, 1, 1, 1), ("c", "conflict"): (0.0, 0.0, 0, 0, 0), ("a", "hub"): (3.5, 10.0, 3, 3, 2), ("b", "hub"): (1.0, 2.86, 2, 2, 2), ("c", "hub"): (0.0, 0.0, 0, 0, 0),
    }
    both = dimensions.scores(systems, facts, ["conflict", "hub"])
    assert of(both) == want
    # one dimension at a time gives the same, and takes only its own place
    hub = dimensions.scores(systems, facts, ["hub"])
    assert of(hub) == {k: v for k, v in want.items() if k[1] == "hub"}
    assert of(dimensions.replaced(both.where("system = 'a'"), hub)) == {k: v for k, v in want.items() if k[1] == "hub" or k[0] == "a"}
    assert dimensions.scores(systems.where("false"), facts, ["hub"]).count() == 0
    assert {v[1] for v in of(dimensions.scores(systems, facts.where("false"), ["hub", "new"])).values()} == {0.0}


def test_ranks_and_evidence(spark):
    systems = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "system string")
    facts = spark.createDataFrame(ROWS, FACTS)
    scored = dimensions.scores(systems, facts, ["conflict", "hub"])
    assert [(r["rank"], r.system) for r in dimensions.ranked(scored).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    judged = spark.createDataFrame([("d", 1, "S", "why"), ("b", 2, None, None), ("nobody", 3, "x", "x")], "system string, place int, grade string, rationale string")
    got = [tuple(r) for r in dimensions.ranked(scored, judged).orderBy("rank").collect()]
    assert [r[1] for r in got] == ["d", "b", "a", "c"] and got[0][4:] == ("S", "why") and got[2][2:4] == (20.0, {"conflict": 10.0, "hub": 10.0})
    shown = defaultdict(list)
    for r in dimensions.evidence(facts, {"conflict": 2, "hub": 1}).orderBy("place").collect():
        shown[r.system, r.dimension].append((r.topic, r.grade))
    assert shown["a", "conflict"] == [("t1", "high"), ("t1", "medium")] and shown["a", "hub"] == [("b", "strong")] and ("b", "hub") not in shown and ("c", "other") not in shown
