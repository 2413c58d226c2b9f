import json
import re

import pytest
from pyspark.sql import functions as F

from quarry import evaluation
from quarry.functions import json_blocks, places
from quarry.operators import graph, rules

TEXTS = [
    "", None, "no match", "![a](b)", "x ![é日](p/q.png) y ![](z \"t\")![1](2)", "![broken](", "![a]() ![[b]](c)", "😀 ![😀](😀.png) end", "aXbXX\nX", "X", "XX",
]


@pytest.mark.parametrize("pattern", [places.IMAGE, "X", r"(?<=b)X|X(?=X)", r"\w+", r"[^X]+"])
def test_matches_are_those_of_finditer(spark, pattern):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", places.matches(F.col("t"), f"(?U){pattern}").alias("m"))
    got = {r.i: r.m for r in rows.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (None if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]), t


def test_image_places(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", places.image_places(F.col("t")).alias("m"))
    for r in rows.collect():
        t = TEXTS[r.i]
        assert r.m == (None if t is None else [(m[1], m[2], m.start(), m.end()) for m in re.finditer(places.IMAGE, t)])


ANSWERS = {
    'a {"x": 1} b {"y": {"z": [1, "}"]}} c': ['{"x": 1}', '{"y": {"z": [1, "}"]}}'],
    'it\'s "so {"q": "say \\"{\\" ok"} and': ['{"q": "say \\"{\\" ok"}'],
    'cut {"a": [1, 2, {"b": "unfin': ['{"a": [1, 2, {"b": "unfin"}]}'],
    'cut {"a": 1, "b": [true, fal': ['{"a": 1, "b": [true]}'],
    'cut {"a": 1, "b"': ['{"a": 1}'],
    'cut {"a': ["{}"],
    '{"a": "x\\': ["{}"],
    "{not json} {\"real\": 1}": ['{"real": 1}'],
    '{ {"in": 1} }': [],
    '[{"a": 1}, {"b": 2}]': ['{"a": 1}', '{"b": 2}'],
    '{"a": ]} {"b": 1}': ['{"b": 1}'],
    "no } objects {": ["{}"],
    "": [],
    None: None,
}


def test_json_objects(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, t string").select("i", json_blocks.json_objects("t").alias("o"))
    for r in rows.collect():
        text, want = list(ANSWERS.items())[r.i]
        assert (r.o if r.o is None else [json.loads(x) for x in r.o]) == (want if want is None else [json.loads(x) for x in want]), text


def test_long_answers(spark):
    long = json.dumps({"list": [{"n": i, "text": "} { " * 5} for i in range(20_000)]})
    deep = '{"a":' * 400
    rows = spark.createDataFrame([(0, "so: " + long + " done"), (1, long[:-50]), (2, deep), (3, "{" * 3000)], "i int, t string").select("i", json_blocks.json_objects("t").alias("o"))
    got = {r.i: r.o for r in rows.collect()}
    assert got[0] == [long] and len(json.loads(got[1][0])["list"]) == 19_999 and len(got[2]) == 1 and got[3] == ["{}"]


def test_rules(spark):
    says = lambda **k: k
    table = [(3, "a/", r"^a/(\w+)$", says(kind="one", title="$1")), (1, "a/b", r"^a/b(c+)", says(kind="two", title="$1!")), (2, "", r"\.md$", says(kind="doc")), (2, "", "never", says(kind="x")), (9, "é/", r"(\d+)-(\d+)", says(kind="n", title="$2 $1")), (None, None, "x", says())]
    df = spark.createDataFrame(table, "rank int, prefix string, pattern string, says map<string,string>")
    paths = ["a/x", "a/bcc/d", "a/bx.md", "q.md", "é/page-12-345\n", "", None, "zzz", "a/x"]
    rows = spark.createDataFrame([(i, p, "k") for i, p in enumerate(paths)], "i int, path string, prefix string")
    got = {r.i: (r["rank"], r.said) for r in rules.first_rule(rows, df).collect()}
    assert got == {
        0: (3, {"kind": "one", "title": "x"}), 1: (1, {"kind": "two", "title": "cc!"}), 2: (2, {"kind": "doc"}), 3: (2, {"kind": "doc"}), 4: (9, {"kind": "n", "title": "345 12"}), 5: (None, None), 6: (None, None), 7: (None, None), 8: (3, {"kind": "one", "title": "x"}),
    }
    assert rules.first_rule(rows, df.where("false")).where("rank is not null").count() == 0 and rules.first_rule(rows.where("false"), df).count() == 0


def test_paths_meet_rules_of_their_prefixes_only(spark):
    many = spark.range(200).select(F.col("id").cast("int").alias("rank"), F.format_string("p%03d/", "id").alias("prefix"), F.lit(".*").alias("pattern"), F.create_map(F.lit("k"), F.lit("v")).alias("says"))
    paths = spark.range(4000).select(F.format_string("p%03d/x%d", F.col("id") % 250, "id").alias("path"))
    out = rules.first_rule(paths, many)
    assert "Nested" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("rank is not null").count() == 3200


def test_edges_and_sources(spark):
    nodes = spark.createDataFrame([("a", ["b", "b", "z"], "first", 1), ("b", None, "second", 2), ("c", [], "third", 3)], "name string, related array<string>, description string, sheet_count int")
    got = sorted(map(tuple, graph.edges_with_attributes(nodes).collect()), key=str)
    assert got == sorted([("a", "b", "second", 2, 3), ("a", "b", "second", 2, 3), ("a", "z", None, None, 3)], key=str)
    one = spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, "y", 3)], "name string, said string, n int")
    two = spark.createDataFrame([("a", "late", 9.5), ("c", "only", 1.5)], "name string, said string, extra double")
    assert sorted(map(tuple, graph.united(one, two).collect())) == [("a", "late", 1, 9.5), ("b", "x", 2, None), ("c", "only", None, 1.5)]


def test_questions(spark):
    rows = spark.createDataFrame([("Key", "3", "no", "한국 말"), (" ", "1", "x", "y"), ("K2", "v" * 25, "plain", None), ("K3", None, None, "말" * 80)], "k string, v string, c1 string, c2 string")
    got = {r.id: (r.question.split(" 의 정확")[0], r.must_contain) for r in evaluation.key_value_questions(rows, "f", "s", "k", "v", ["c1", "c2"]).collect()}
    assert got == {"kv-f-Key": ("한국 말", ["Key", "3"]), "kv-f-K2": ("K2", ["K2"]), "kv-f-K3": ("말" * 60, ["K3"])}
