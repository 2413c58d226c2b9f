from pyspark.sql import functions as F

from quarry.documents import cleanup, grid, markdown

DOC = "---\nkey: v\nother: a: b\nkey: last\n---\n# Title\nintro\n## One\nbody one\n### Sub\nx\n## Two\n\n## Three\n| a | b |\n|---|---|\n| 1 | 2 |\ntext\n```\n## not a heading\n```\n"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_front_matter(spark):
    got = [r.m for r in docs(spark, DOC, "none").select(markdown.front_matter(F.col("text")).alias("m"), "doc_id").orderBy("doc_id").collect()]
    assert got == [{"other": "a: b", "key": "last"}, {}]


def test_sections(spark):
    text = markdown.without_front_matter(F.col("text"))
    rows = markdown.sections(docs(spark, DOC, "plain", None, "").withColumn("text", text)).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.heading) for r in rows] == [(0, "Title"), (0, "One"), (0, "Three"), (0, "not a heading"), (1, "")]
    assert rows[0].text == "intro" and rows[1].text == "body one\n### Sub\nx"


def test_chunks_pack_and_drop(spark):
    big = "## A\n" + "\n".join(f"### S{i}\n" + "w" * 300 for i in range(6)) + "\n## B\nsmall"
    rows = markdown.chunks(docs(spark, big, "## X\ntiny\n## Y\ntoo"), most=400, least=100).orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, r.chunk, r.heading) for r in rows] == [(0, 0, "A"), (0, 1, "A"), (0, 2, "A"), (1, 0, "X")]
    assert all(r.tokens <= 400 for r in rows) and rows[-1].text == "tiny\n\ntoo"
    kept = markdown.chunks(docs(spark, big), most=400, least=100, keep_small=True)
    assert kept.count() == 4


def test_headings_and_ranges(spark):
    text = "# A\na\n## B\nb\n### C\nc\n## D\nd\n# E\n```\n# no\n```"
    rows = markdown.headings(docs(spark, text)).orderBy("pos").collect()
    assert [(r.title, r.level, r.ends) for r in rows] == [("A", 1, 8), ("B", 2, 6), ("C", 3, 6), ("D", 2, 8), ("E", 1, None)]
    got = [r.line for r in markdown.section_lines(docs(spark, text), "b").orderBy("pos").collect()]
    assert got == ["## B", "b", "### C", "c"]


def test_tables_images_records(spark):
    rows = markdown.tables(docs(spark, DOC + "\n| c |\n| d\\|e |\n")).orderBy("table", "row").collect()
    assert [(r.table, r.row, r.cells) for r in rows] == [(0, 0, ["a", "b"]), (0, 1, ["1", "2"]), (1, 0, ["c"]), (1, 1, ["d\\|e"])]
    one = docs(spark, "![x](a.png) ![](b.png \"t\")").select(markdown.images(F.col("text")).alias("i")).first().i
    assert [(i.alt, i.path) for i in one] == [("x", "a.png"), ("", "b.png")]
    got = docs(spark, "... depotFile //a/b.xlsx\n... rev 3\n\n... depotFile //c\n\nnoise").select(markdown.records(F.col("text")).alias("r")).first().r
    assert got == [{"depotFile": "//a/b.xlsx", "rev": "3"}, {"depotFile": "//c"}]
    changes = markdown.change_lists(docs(spark, "Change 12 on 2024/01/02 by ann@ws\n\n\tfirst\n\tsecond\n\nChange 11 on 2024/01/01 by bob@ws\n\tother")).orderBy("change").collect()
    assert [(c.change, c.user, c.day, c.description) for c in changes] == [(11, "bob", "2024/01/01", "other"), (12, "ann", "2024/01/02", "first\nsecond")]


def frame(spark, *rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "doc_id long, pos int, level int, title string, body string")


def left(df):
    return [(r.pos, r.body) for r in df.orderBy("pos").collect()]


def test_repeats(spark):
    f = frame(spark, (2, "1. A", "x"), (2, "A", "longer"), (2, "B", "same"), (2, "B", "emas"), (3, "A", "longer"), (2, "C", "z"))
    assert left(cleanup.without_repeats(f)) == [(1, "longer"), (3, "emas"), (4, "longer"), (5, "z")]
    assert left(cleanup.without_cross_level_repeats(f))[1] == (1, "longer") and (4, "longer") not in left(cleanup.without_cross_level_repeats(f))
    twins = frame(spark, (2, "A", "- x"), (2, "B", "x"), (2, "C", "y"))
    assert left(cleanup.without_twin_neighbours(twins)) == [(1, "x"), (2, "y")]
    heads = frame(spark, (1, "T", ""), (2, "A", ""), (2, "a", "x"), (1, "T", ""), (2, "B", "y"), (2, "Z", ""))
    assert [p for p, _ in left(cleanup.without_repeated_headings(heads))] == [0, 2, 4, 5]
    assert [p for p, _ in left(cleanup.without_lone_headings(heads))] == [0, 2, 3, 4]
    goes_on = frame(spark, (2, "A", "x"), (2, "A (계속)", "y"), (2, "B (계속)", "z"))
    assert [(r.title, r.body) for r in cleanup.continued(goes_on).orderBy("pos").collect()] == [("A", "x\n\ny"), ("B", "z")]
    same = frame(spark, (2, "A", "x"), (2, "A", "y"), (3, "A", "z"), (2, "A", "w"))
    assert [(r.level, r.body) for r in cleanup.continued(same).orderBy("pos").collect()] == [(2, "x\n\ny"), (3, "z"), (2, "w")]


def test_marks_of_headings_only(spark):
    text = "## A (계속)\nsee below (continued)\n\nmore"
    assert docs(spark, text).select(cleanup.without_marks(F.col("text")).alias("t")).first().t == "## A\nsee below (continued)\n\nmore"
    assert docs(spark, text).select(cleanup.without_marks(F.col("text"), continued=False).alias("t")).first().t == text


def test_marks_and_round_trip(spark):
    text = "# T\n## 타일 3\nx\n\n\n\n\ny"
    assert docs(spark, text).select(cleanup.without_marks(F.col("text")).alias("t")).first().t == "# T\nx\n\n\ny"
    again = cleanup.rendered(cleanup.section_frame(docs(spark, "pre\n# A\na\n## B\nb"))).first().text
    assert again == "pre\n\n# A\na\n\n## B\nb"


def test_tables_merge(spark):
    t = spark.createDataFrame([("s", 0, 0, ["h"]), ("s", 0, 1, ["1"]), ("s", 1, 0, ["h"]), ("s", 1, 1, ["2"]), ("s", 1, 2, ["1"]), ("s", 2, 0, ["k"])], "title string, table int, row int, cells array<string>")
    rows = cleanup.merged_tables(t, ["title"]).orderBy("table", "row").collect()
    assert [(r.table, r.row, r.cells) for r in rows] == [(0, 0, ["h"]), (0, 1, ["1"]), (0, 2, ["2"]), (2, 0, ["k"])]


def test_bold_twins_and_quotes(spark):
    lines = markdown.lines(docs(spark, "# Head\n**Head**\ntext\n**Other:**"))
    assert [r.line for r in cleanup.without_bold_twins(lines).orderBy("pos").collect()] == ["# Head", "text", "**Other:**"]
    quotes = spark.createDataFrame([("a", "it  is"), ("a", "no"), ("b", "x")], "k string, quote string")
    found = cleanup.quotes_found(quotes, spark.createDataFrame([("a", "so “it\nis”")], "k string, text string"), "k").orderBy("k").collect()
    assert [(r.k, r.found, r.percent, r.mark) for r in found] == [("a", 1, 50.0, "weak"), ("b", 0, 0.0, "bad")]


def test_grid(spark):
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 1, 3, "c"), ("s", 2, 1, "1"), ("s", 2, 3, "3"), ("s", 1, 5, "x"), ("s", 1, 6, "y"), ("s", 1, 7, "z"), ("s", 2, 6, "9"), ("s", 4, 1, "late")], "sheet string, row int, col int, value string")
    out = grid.tables(cells).orderBy("table", "row", "col").collect()
    assert [r.value for r in out if r.table == 0] == ["a", "b", "c", "1", "", "3"] and [r.value for r in out if r.table == 1] == ["x", "y", "z", "", "9", ""]
    assert [r.line for r in grid.table_lines(grid.tables(cells)).orderBy("table", "row").collect()][1] == "| 1 |  | 3 |"
    runs = grid.clusters(cells).orderBy("row", "first").collect()
    assert [(r.row, r.first, r.last) for r in runs] == [(1, 1, 3), (1, 5, 7)]
    merges = spark.createDataFrame([("s", 1, 1, 3, 1)], "sheet string, min_row int, min_col int, max_row int, max_col int")
    got = {(r.row, r.col): r.value for r in grid.filled(cells, merges).collect()}
    assert got[(3, 1)] == "a" and got[(2, 1)] == "1" and len(got) == 11
    wide = spark.createDataFrame([(None, "", "k", "v", "한글"), ("", " ", "", "w", "x")], "a string, b string, c string, d string, e string")
    assert grid.non_empty(wide, 2).columns == ["c", "d"]
    assert [tuple(r) for r in grid.key_values(wide, "c", "d", ["a", "e"]).collect()] == [("k", "v", "한글")]
