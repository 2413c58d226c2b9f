from pyspark.sql import functions as F

from quarry.operators import graph, views
from quarry.search import lookup


def test_glossary_and_tables(spark):
    terms = spark.createDataFrame([("HP", "life"), ("HP bar", "its bar"), ("MP", "mana")], "term string, meaning string")
    assert [r.term for r in lookup.glossary(terms, "hp").collect()] == ["HP"]
    assert [r.term for r in lookup.glossary(terms, "hp bar size").collect()] == ["HP", "HP bar"] and lookup.glossary(terms, "zz").count() == 0
    tables = spark.createDataFrame([("A", "s", "t1", "Drops"), ("A", "s", "t2", "Drop rates"), ("B", "x", "t1", "Skills")], "workbook string, sheet string, table_id string, table_name string")
    assert lookup.table_at(tables, name="rate").first().table_id == "t2" and lookup.table_at(tables, "B", "x", "t1").first().table_name == "Skills"
    assert lookup.listed(tables, "a").count() == 2


def test_other_products(spark):
    files = spark.createDataFrame([("g", "a.md", "gold Gold x gold"), ("g", "b.md", "gold"), ("h", "c.md", "silver")], "game string, path string, text string")
    assert [(r.path, r.hits) for r in lookup.raw_search(files, "Gold", 1).collect()] == [("a.md", 3)]
    assert [r.path for r in lookup.mentions_together(files, ["GOLD", "au"], ["x"]).collect()] == ["a.md"]
    nodes = spark.createDataFrame([("g", "Gold mine", "place", "abc"), ("g", "x", "gold", "abcd"), ("g", "y", "z", "w")], "game string, name string, category string, text string")
    assert [(r.name, r.score) for r in lookup.node_search(nodes, "gold").orderBy("rank").collect()] == [("Gold mine", 103), ("x", 34)]
    names = lookup.canonical_name(spark.createDataFrame([("Lost_Ark",), ("other-Game",)], "name string"), spark.createDataFrame([("lost ark", "LA")], "alias string, canonical string"))
    assert {tuple(r) for r in names.collect()} == {("Lost_Ark", "LA"), ("other-Game", "other game")}


def test_aliases_reasons_retries(spark):
    sheets = spark.createDataFrame([("PK_Skill_Tree v2", "Main")], "workbook string, sheet string")
    got = {r.alias: r.weight for r in lookup.aliases_of(sheets, spark.createDataFrame([("main", "chief")], "word string, other string")).collect()}
    assert got["pk_skill_tree v2"] == 1.0 and got["skill tree v2"] == 0.9 and got["skill_tree"] == 0.8 and got["main"] == 0.6 and abs(got["chief"] - 0.54) < 1e-9
    a, b = (spark.createDataFrame(rows, "id int, score double") for rows in ([(1, 0.5)], [(1, 0.9), (2, 0.3), (3, 0.95)]))
    assert {tuple(r) for r in lookup.merged_retry(a, b).collect()} == {(1, 0.5), (2, 0.8), (3, 0.95)}
    assert {tuple(r) for r in lookup.first_reason([("a", a), ("b", b)], "id").collect()} == {(1, "a"), (2, "b"), (3, "b")}
    questions = spark.createDataFrame([(2, "What is the skill tree of A"), (1, "what is the  skill tree of B"), (3, "other")], "id int, query string")
    assert sorted(r.id for r in lookup.distinct_questions(questions).collect()) == [1, 3]


def test_paths(spark):
    r = spark.createDataFrame([("see /home/u/a.txt and C:\\x\\y or a/b",)], "t string").select(lookup.without_internal_paths(F.col("t")).alias("r")).first().r
    assert r.text == "see [path] and [path] or a/b" and r.warnings == ["/home/u/a.txt", "C:\\x\\y"]
    labels = spark.createDataFrame([("/wiki/a.md",), ("/x/b.xlsx",), ("?",)], "p string").select(lookup.by_rules(F.col("p"), [("^/wiki/", "wiki"), (r"\.xlsx$", "sheet")]).alias("l"))
    assert [r.l for r in labels.collect()] == ["wiki", "sheet", "unknown"]


def test_views(spark):
    sources = spark.createDataFrame([(1,), (2,)], "id int")
    documents = spark.createDataFrame([(1, "crawl"), (1, "crawl"), (1, "convert")], "source_id int, stage string")
    jobs = spark.createDataFrame([(1, 1, "crawl", "completed", "2024-01-01"), (2, 1, "crawl", "running", "2023-01-01"), (3, 2, "index", "failed", "2024-01-01")], "id int, source_id int, stage string, status string, created_at string")
    got = {(r.source_id, r.stage): (r.documents, r.running, r.failed, r.last_status) for r in views.stage_view(sources, documents, jobs).collect()}
    assert len(got) == 10 and got[(1, "crawl")] == (2, 1, 0, "running") and got[(2, "index")] == (0, 0, 1, "failed") and got[(2, "crawl")] == (0, 0, 0, None)
    assert views.stage_edges()[0] == ("crawl", "capture")
    chunks = spark.createDataFrame([("A", "s1", "x", "| a |\n|---|\n"), ("A", "s2", "y", "```mermaid")], "workbook string, sheet string, section_path string, text string")
    r = views.system_features(chunks).first()
    assert (r.sheets, r.tables, r.charts, r.sections) == (["s1", "s2"], 1, 1, ["x", "y"])
    reports = spark.createDataFrame([(1, "A", "B", [("t", "hp", "high", "10", "20"), ("t", "mp", "low", "5", " ")])], "pair_id int, left string, right string, conflicts array<struct<type:string,topic:string,severity:string,left_says:string,right_says:string>>")
    evidence = graph.edge_evidence(reports)
    assert evidence.count() == 3 and [r.topic for r in graph.paired_topics(evidence).collect()] == ["hp"]
    assert {tuple(r) for r in views.severity_counts(evidence).collect()} == {("high", 1), ("low", 1)}
