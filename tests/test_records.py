"""Ingest of workbook folders, stored vectors, trees, summaries and conversations at their edges."""

import datetime

from pyspark.sql import functions as F

from quarry.documents import trees
from quarry.functions import text as X
from quarry.operators import conversations
from quarry.search import store, summaries
from quarry.sources import ingest

from .test_sources import write_workbook


def test_ingest(spark, tmp_path):
    (tmp_path / "in" / "Enum").mkdir(parents=True)
    head, meta = ["Id", "ItemId", "Kind"], ["type=int32", "type=int32", "type=ItemKind"]
    write_workbook(tmp_path / "in" / "A.xlsx", {"Item": [head, meta, [1, 2, "Sword"], [2, 1, "Bow"]], "Info": [["x"]], "Loose Sheet": [["Id"], ["type=int32"], [7]]})
    write_workbook(tmp_path / "in" / "B.xlsx", {"Item": [head, meta, [9, 9, "Bow"]], "Reward": [["Id", "ItemId"], ["type=int32", "type=int32"], [1, 2]]})
    write_workbook(tmp_path / "in" / ingest.REGISTRY, {"T": [["name", "cs", "only"], ["Item", "c", None], ["Reward", None, 1]]})
    write_workbook(tmp_path / "in" / "Enum" / "ItemKind.xlsx", {"E": [["n", "v"], ["Sword", 1], ["Bow", 2], ["Bow", 3]]})
    into = str(tmp_path / "out")
    report = ingest.ingest(spark, str(tmp_path / "in"), into)
    got = sorted((r.file.rsplit("/", 1)[1], r.sheet, r.table_name, r.column_count, r.row_count, r.registered, r.status) for r in report.collect())
    assert got == [
        ("A.xlsx", "Item", "Item", 3, 2, True, "stored"), ("A.xlsx", "Loose Sheet", "Loose_Sheet", 1, 1, False, "stored"),
        ("B.xlsx", "Item", "Item", 3, 1, True, "duplicate"), ("B.xlsx", "Reward", "Reward", 2, 1, True, "stored"),
    ]
    assert tuple(ingest.totals(report).first()) == (3, 4, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{into}/Item").collect()) == [(1, 2, "Sword"), (2, 1, "Bow")]
    assert {(r.table_name, r.cs, r.row_count) for r in spark.read.parquet(f"{into}/_catalog").collect()} == {("Item", "c", 2), ("Reward", "cs", 1), ("Loose_Sheet", "cs", 1)}
    assert {(r.source_table, r.source_column, r.target_table) for r in spark.read.parquet(f"{into}/_keys").collect()} == {("Reward", "ItemId", "Item"), ("Item", "Kind", "ItemKind")}
    assert spark.read.parquet(f"{into}/_enums").count() == 2
    assert {(r.table_name, r.only_schema) for r in spark.read.parquet(f"{into}/_registry").collect()} == {("Item", False), ("Reward", True)}
    dry = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "dry"), dry_run=True)
    assert {r.status for r in dry.collect()} == {"parsed", "duplicate"} and not (tmp_path / "dry" / "Item").exists()


def test_store(spark, tmp_path):
    rows = [("W b", "S", "a/b", 0, "t", [1.0]), ("W b", "S", "a/b", 0, "s", [2.0]), (None, None, None, 1, None, None)]
    made = store.entries(spark.createDataFrame(rows, "workbook string, sheet string, section_path string, place int, text string, vector array<double>"), "place")
    store.save(made, str(tmp_path / "v"))
    got = {r.id: (r.document, r.vector, r.facts.workbook, r.facts.chunk_type) for r in store.load(spark, str(tmp_path / "v")).collect()}
    assert got == {"W_b__S__a_b__0": ("s", [2.0], "W b", "content"), "______1": (None, None, None, "content")}


def test_trees(spark):
    deep = "".join('{"id": %d, "title": "t", "children": [' % i for i in range(200)) + "]}" * 200
    rows = [(1, '{"id": 1, "title": "A", "type": "folder", "children": [{"id": 2, "title": "B", "version": 3}, {"id": 2, "title": "C", "version": 4}]}'), (2, "[1"), (3, None), (4, "7"), (5, deep)]
    nodes = trees.nodes(spark.createDataFrame(rows, "tree int, manifest string"))
    assert [tuple(r) for r in nodes.where("tree = 1").orderBy("place").select("id", "parent", "kind", "version", "path").collect()] == [("1", None, "folder", 0, "A"), ("2", "1", "page", 3, "A/B"), ("2", "1", "page", 4, "A/C")]
    assert {r.tree: r["count"] for r in nodes.groupBy("tree").count().collect()} == {1: 3, 5: 200}
    assert {(r.id, r.title, r.version) for r in trees.versions(nodes.where("tree = 1"), "tree").collect()} == {("1", "A", 0), ("2", "C", 4)}
    put = spark.createDataFrame([("ab", 2), ("a\nb", 1), ("ab", 1), ("", 0), (None, 0)], "s string, n int").select(trees.with_piece(F.col("s"), F.col("n"), F.lit("x"))).collect()
    assert [r[0] for r in put] == ["ab\n> x\n", "a\n> x\n\nb", "a\n\n> x\nb", "\n> x\n", None]


def test_summaries(spark):
    rows = [("xlsx/Book/S.md", "## 핵심 용어\n- a\n\n  -- b\nend\n- c"), ("xlsx/7_X/S.md", None), ("xlsx/S.md", "x"), ("other/a/b.md", "x"), ("confluence/P.md", "# h\n> q\n" + "y" * 300)]
    got = {r.file: r for r in summaries.summaries(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert set(got) == {"xlsx/Book/S.md", "xlsx/7_X/S.md", "confluence/P.md"}
    assert (got["xlsx/Book/S.md"].doc_id, got["xlsx/Book/S.md"].key_terms) == ("xlsx::Book::S", ["a", "b"])
    assert (got["xlsx/7_X/S.md"].workbook, got["xlsx/7_X/S.md"].summary, got["xlsx/7_X/S.md"].key_terms) == ("7_X", "", [])
    assert (got["confluence/P.md"].path, got["confluence/P.md"].doc_id, got["confluence/P.md"].summary) == ("? / P", "conf::?/P", "y" * 200)


def test_named_sources(spark):
    df = spark.createDataFrame([("[출처 2: a / b] x [출처:c/d / e f ]",), ("[출처: a]",), (None,)], "s string").select(X.named_sources(F.col("s")))
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.collect()] == [[("a", "b", None), ("c", "d", "e f")], [], None]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "q"), (1, 4, "a")], "conv_id int, turn int, text string")
    new = spark.createDataFrame([(1, 20, "y"), (1, 10, "x"), (2, 1, "z"), (2, 1, "z")], "conv_id int, at int, text string")
    got = conversations.appended(turns, new, "at").select("conv_id", "turn", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "q"), (1, 4, "a"), (1, 5, "x"), (1, 6, "y"), (2, 0, "z"), (2, 1, "z")]
    assert conversations.appended(turns, new.limit(0), "at").count() == 2
    then, now = datetime.datetime(2020, 1, 1), F.expr("TIMESTAMP '2024-01-01'")
    heads = spark.createDataFrame([(1, "t", then, then)], "conv_id int, title string, created_at timestamp, updated_at timestamp")
    both = conversations.forked(heads, turns, spark.createDataFrame([(1, 5), (9, 6)], "conv_id int, new_id int"), now)
    assert sorted((r.conv_id, r.title, r.updated_at.year) for r in both[0].collect()) == [(1, "t", 2020), (5, "(fork) t", 2024)]
    assert sorted((r.conv_id, r.turn) for r in both[1].collect()) == [(1, 0), (1, 4), (5, 0), (5, 4)]
    assert conversations.title_of is not None and [r.title for r in conversations.summarised(spark.createDataFrame([(1, 0, "w" * 41)], "conv_id int, turn int, text string")).collect()] == ["w" * 40 + "..."]
