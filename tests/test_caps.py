"""Neither lengths of names nor depths of trees are capped; rules that depend on order or shortness."""

from pyspark.sql import functions as F

from quarry.operators import graph, joins
from quarry.search import retrieval


def test_names_of_many_lengths(spark):
    words = [f"w{i}" for i in range(80)]
    names = spark.createDataFrame([(" ".join(words[:n]),) for n in range(1, 71)], "n string")
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "w0 w1")], "id int, t string")
    got = {(len(r.n.split()), r.id) for r in joins.containing(names, texts, "n", "id", "t").collect()}
    assert got == {(n, 1) for n in range(1, 71)} | {(1, 2), (2, 2)}


def test_deep_trees(spark):
    chain = [(i, i - 1 if i else None, str(i)) for i in range(36)]
    loop = [(100, 101, "x"), (101, 100, "y"), (102, 100, "z"), (103, 103, "own")]
    nodes = spark.createDataFrame(chain + loop, "id int, up int, name string")
    got = {r.id: r.path for r in graph.paths_to_root(nodes, "id", "up", "name").collect()}
    assert got == {i: "/".join(map(str, range(i + 1))) for i in range(36)}


def test_short_names_by_ratio(spark):
    """Names under three characters match longer ones whose ratio allows it."""
    a, b = (spark.createDataFrame([(x,) for x in names], "n string") for names in (["ab", "x", "abcd", "q"], ["abc", "zz", "Q", "xy", "bcd"]))
    got = {(r.left, r.right): round(r.ratio, 2) for r in joins.alike(a, b.withColumnRenamed("n", "m"), "n", "m").collect()}
    assert got == {("ab", "abc"): 0.67, ("abcd", "abc"): 0.75, ("q", "Q"): 1.0}


def test_worst_severity_of_each_type(spark):
    rows = [("p", s, "hp", t, v, "x") for s in ("left", "right") for t, v in (("value", "minor"), ("value", "critical"), ("name", "major"))] + [("p", "left", "mp", "value", "major", "x")]
    got = graph.paired_topics(spark.createDataFrame(rows, "pair_id string, side string, topic string, type string, severity string, says string")).orderBy("rank")
    assert [(r.type, r.topic, r.severity) for r in got.collect()] == [("value", "hp", "critical"), ("name", "hp", "major")]


def test_sheet_marks_by_precedence(spark):
    chunks = spark.createDataFrame([("w", "a_b:skill", "", "x"), ("w", "01_skill-b", "", "x")], "workbook string, sheet string, section_path string, text string")
    got = {r.sheet: r.score for r in retrieval.structural(chunks, ["w"], "skill").collect()}
    plain = retrieval.structural(chunks.withColumn("sheet", F.lit("skill")), ["w"], "skill").first().score
    assert got["a_b:skill"] == plain
