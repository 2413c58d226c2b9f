
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import evaluation
from quarry.search import lexical, retrieval


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "xlsx", "몬스터 왕", "PK_몬스터_왕", None, "/a/몬스터_왕.xlsx", "보스", ["HP", "왕관"]),
        (2, "xlsx", "로바르스", "PK_보스", None, "/a/b.xlsx", "설명 " * 30, ["스킬"]),
        (3, "wiki", "Skill tree", None, "Design", "/w/skill.md", "about hp", []),
        (4, "wiki", "Tree", None, "Skill space", "/w/tree.md", "", None),
    ]
    return lexical.prepared(spark.createDataFrame(rows, "doc_id int, kind string, title string, workbook string, space string, path string, summary string, key_terms array<string>"))


@pytest.mark.parametrize("query,expected", [
    ("몬스터 왕", {1: (1.0, "title_exact")}), ("skill", {3: (0.95, "title_prefix"), 4: (0.82, "space_substring")}), ("몬스터왕", {1: (0.86, "workbook_substring_ns")}),
    ("hp", {1: (0.80, "key_term_exact"), 3: (0.40, "summary_substring")}), ("tree", {4: (1.0, "title_exact"), 3: (0.85, "title_substring")}), ("르바", {2: (pytest.approx(0.45 + 0.1 * (2 / 3 - 0.6) / 0.4), "title_fuzzy_jamo")}), ("zz", {}),
])
def test_tiers(docs, query, expected):
    rows = docs.select("doc_id", lexical.score(query).alias("s")).where("s is not null").collect()
    assert {r.doc_id: (r.s.score, r.s.via) for r in rows} == expected


def test_all_words_count_more(docs):
    got = {r.doc_id: (r.score, r.via) for r in lexical.search(docs, "skill tree", balance=False).collect()}
    assert got[3] == (1.0, "title_prefix") and got[4][0] == 1.0
    assert lexical.search(docs, "  ").count() == 0
    assert {r.doc_id for r in lexical.search(docs, "hp", kinds=["wiki"]).collect()} == {3}


def test_grouping_and_folding(spark):
    hits = spark.createDataFrame([("f", "a", 1.0), ("f", "b", 2.0), ("g", "c", 0.5)], "folder string, item string, score double")
    assert {(r.group, r.size) for r in lexical.grouped_hits(hits, "folder", "item").collect()} == {("f", 2), ("c", 1)}
    top = lexical.folded(hits, "folder", "item", "score", 5).orderBy("rank").collect()
    assert [(r.folder, r.total, r.sheets, r.seed) for r in top] == [("f", 3.0, ["b", "a"], "b"), ("g", 0.5, ["c"], "c")]
    both = lexical.merged(spark.createDataFrame([(1, 0.5, "l1")], "doc_id int, score double, source string"), spark.createDataFrame([(1, 0.7, "vector"), (2, 0.1, "vector")], "doc_id int, score double, source string"))
    assert {(r.doc_id, r.score, r.source) for r in both.collect()} == {(1, 0.7, "both"), (2, 0.1, "vector")}
    ranked = lexical.palette(spark.createDataFrame([("Monster King", "/x/mk.md"), ("zzz", "/m/k"), ("q", "/q")], "title string, path string"), "mk")
    assert [r.title for r in ranked.collect()] == ["Monster King", "zzz"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "A", "fields: skill list", "skill intro", "Skill text about damage", 100, [1.0, 0.0]), (2, "A", "other", "x", "nothing", 50, [0.0, 1.0]), (3, "B", "s", "damage", "Attack Power Param here", 80, [0.6, 0.8]),
        (4, "B", "s", "", "zero", 10, [0.0, 0.0]), (5, "C", "t", "", "no vector", 10, None),
    ]
    return spark.createDataFrame(rows, "id int, workbook string, sheet string, section_path string, text string, tokens int, embedding array<double>")


def test_vectors(chunks):
    got = [(r.id, r.score) for r in retrieval.nearest(chunks, [1.0, 0.0], 9).collect()]
    assert got == [(1, 1.0), (3, 0.6), (2, 0.0)]
    assert [r.id for r in retrieval.nearest(chunks, [1.0, 0.0], 1, where=F.col("workbook") == "B").collect()] == [3]


def test_structural(chunks):
    got = {r.id: r.score for r in retrieval.structural(chunks, ["A"], "skill damage").collect()}
    assert got == {1: 1.5, 2: pytest.approx(0.6)}
    assert {r.id: r.score for r in retrieval.structural(chunks, ["A"], "skill damage", {"skill": "list"}).collect()}[1] == 1.5


def test_phrases(chunks):
    got = {r.id: (r.score, r.compound) for r in retrieval.phrase_search(chunks, ["Attack Power", "here", "damage"]).collect()}
    assert got == {1: (pytest.approx(0.75), False), 3: (pytest.approx(0.70 + 0.10 + 0.15), True)}
    assert retrieval.phrase_search(chunks, []).count() == 0


def test_fusion(spark):
    layer = lambda *rows: spark.createDataFrame([(i, s, c) for i, s, c in rows], "id int, score double, compound boolean")
    out = retrieval.fused(layer((1, 0.8, False)), layer((1, 0.5, False), (2, 0.4, False)), layer((3, 0.4, False)), layer((1, 0.9, True), (4, 0.7, False), (2, 0.2, False)))
    assert {r.id: round(r.score, 6) for r in out.collect()} == {1: 1.11, 2: 0.45, 3: 0.6, 4: 0.7}


def test_assembly(spark):
    rows = spark.createDataFrame([(1, "A", 0.9, 50), (2, "A", 0.8, 60), (3, "B", 0.7, 30), (4, "C", 0.6, 15), (5, "C", 0.5, 20)], "id int, workbook string, score double, tokens int")
    assert [r.id for r in retrieval.assembled(rows, ["A"], 10, 120).collect()] == [1, 2]
    assert [r.id for r in retrieval.assembled(rows, ["A", "B"], 10, 100).collect()] == [1, 3]


def test_graph_layer_and_sheets(chunks, spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C")], "src string, dst string")
    got = {r.id: r.score for r in retrieval.graph_layer(chunks, edges, ["A"], "damage").collect()}
    assert set(got) == {3, 4, 5} and got[3] == pytest.approx((0.6 + 0.2) / 2)
    hits = spark.createDataFrame([("B", "s", 0.9), ("A", "other", 0.5)], "workbook string, sheet string, score double")
    assert {r.id for r in retrieval.whole_sheets(chunks, hits, budget=120).collect()} == {3, 4}


def test_aliases(spark):
    queries = spark.createDataFrame([(1, "the skill tree of fire skill")], "query_id int, query string")
    aliases = spark.createDataFrame([("skill", "S", 1.0), ("skill tree", "T", 1.0), ("skill tree", "U", 0.5), ("ice", "I", 1.0)], "alias string, target string, weight double")
    assert {(r.alias, r.target) for r in retrieval.alias_hits(queries, aliases).collect()} == {("skill tree", "T"), ("skill", "S")}


def test_evaluation(spark):
    v = lambda *s: spark.range(1).select(evaluation.verdict(F.array(*map(F.lit, s)).cast("array<int>")).alias("v")).first().v
    assert [v(4, 4, 4), v(5, 5, 2), v(3, 3), v(1, 5), v()] == ["PASS", "PARTIAL", "PARTIAL", "FAIL", None]
    df = spark.createDataFrame([("a b", ["a", "b"]), ("a", ["b"]), ("a", [])], "answer string, parts array<string>")
    assert [r.p for r in df.select(evaluation.must_contain(F.col("answer"), F.col("parts")).alias("p")).collect()] == [True, False, None]
    lines = spark.createDataFrame([('{"a": "x", "n": 1}',), ('{"a": 1}',), ("{",)], "line string")
    assert [len(r.errors) for r in evaluation.valid_lines(lines, {"a": "string", "n": "number"}).collect()] == [0, 1, 1]
    assert evaluation.next_id(spark.createDataFrame([("D-0009",), ("X-99",)], "i string"), "i", "D-").first().next_id == "D-0010"
    assert evaluation.next_id(spark.createDataFrame([], "i string"), "i", "D-").first().next_id == "D-0001"
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "case_id int, target string, rank int")
    expected = spark.createDataFrame([(1, "b"), (2, "y"), (3, "q")], "case_id int, target string")
    assert {(r.case_id, r.hit, r.precision) for r in evaluation.hits(results, expected, 3).collect()} == {(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0)}


def test_nearest_each_in_tiles(spark):
    """Against all pairs: many queries, ties, unlike lengths, nulls and zeros, names as ids."""
    rng = np.random.default_rng(4)
    rows = [(f"c{i:03}", (rng.normal(size=4) * 4).round().tolist()) for i in range(300)] + [("z", [0.0] * 4), ("n", None), ("h", [None, 1.0, 1.0, 1.0]), ("s", [1.0, 2.0])] + [(f"t{i}", [1.0, 0.0, 0.0, 0.0]) for i in range(9)]
    asked = [(i, (rng.normal(size=4) * 4).round().tolist()) for i in range(40)] + [(90, [2.0, 0.0, 0.0, 0.0])] * 2 + [(91, None), (92, [0.0] * 4), (93, [1.0, 1.0])]
    want = set()
    for q, y in asked:
        known = [(i, x) for i, x in rows if x and y and len(x) == len(y) and None not in x and any(x) and any(y)]
        scored = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), i) for i, x in known)
        want |= {(q, i, p + 1) for p, (_, i) in enumerate(scored[:5])}
    chunks, queries = spark.createDataFrame(rows, "id string, embedding array<float>"), spark.createDataFrame(asked, "query_id int, embedding array<float>")
    for tile, sets in ((1 << 21, 1 << 18), (200, 30)):
        got = {(r.query_id, r.id, r["rank"]) for r in retrieval.nearest_each(chunks, queries, 5, tile=tile, query_set=sets).collect()}
        assert got == want
