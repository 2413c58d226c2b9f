import re
from collections import defaultdict

from quarry.documents.token_scan import KINDS, cells_of_sheets, cells_of_tables, index, places, tokens_by_kind

CELLS = [
    ("BookOne", "Sheet_A", 1, 1, "KeyName"), ("BookOne", "Sheet_A", 1, 2, "Value_Of"), ("BookOne", "Sheet_A", 1, 3, "Note"), ("BookOne", "Sheet_A", 2, 2, "type=EnumKind"), ("BookOne", "Sheet_A", 3, 1, "KeyName"),
    ("BookOne", "Sheet_A", 3, 2, "FooBar and FooBar, MAX_HP x"), ("BookOne", "Sheet_A", 4, 3, "FooBar"), ("BookOne", "Sheet_A", 4, 1, "FOO_BAR_2"), ("BookOne", "Sheet_A", 5, 2, None), ("BookOne", "Sheet_A", 0, 2, "OutSide"),
    ("BookOne", "HUD", 3, 2, "FooBar"), ("b2", "HUD_SHEET", 1, 1, "FooBar"), ("b2", "HUD_SHEET", 7, 5, "aFooBar Foo_b TRUE_X Ab_Cd"), ("b2", "HUD_SHEET", 7, 5, "Twice_Here"), ("b2", "HUD_SHEET", 7, 5, "Twice_Here"),
]
PATTERNS = (r"\b[A-Z][a-zA-Z0-9]+(?:_[A-Z][a-zA-Z0-9]+)+\b", r"\b[A-Z][a-z]{1,}(?:[A-Z][a-z0-9]+){1,}\b", r"\b[A-Z]{3,}(?:_[A-Z0-9]{2,})+\b")


def brute(cells):
    cells = [c for c in cells if c[4] is not None and c[2] >= 1 and c[3] >= 1]
    heads = {(f, s, c): v for f, s, r, c, v in cells if r == 1}
    keys = {(f, s, r): v for f, s, r, c, v in cells if c == 1}
    out = [(f, "filename", f, "", None, None, None, None) for f in {c[0] for c in cells} if len(f) >= 4] + [(s, "sheet", f, s, None, None, None, None) for f, s in {c[:2] for c in cells} if len(s) >= 4]
    for f, s, r, c, v in cells:
        kind = "header" if r == 1 else "domain-meta" if r == 2 else "kv-key" if c == 1 else "cell"
        for token in dict.fromkeys(m for p in PATTERNS for m in re.findall(p, v)):
            if len(token) >= 4:
                out.append((token, kind, f, s, heads.get((f, s, c)), keys.get((f, s, r)), r, c))
    return out


def test_sheets(spark):
    df = spark.createDataFrame([(*c, "x", "y") for c in CELLS], "file string, sheet string, row int, col int, value string, kind string, header string").repartition(4)
    found, want = places(cells_of_sheets(df)), brute(CELLS)
    assert sorted((tuple(r)[:8] for r in found.collect()), key=str) == sorted(want, key=str)
    by_token = defaultdict(list)
    for p in want:
        by_token[p[0]].append(p)
    for r in index(found, 2).collect():
        own = sorted(by_token[r.token], key=lambda p: (p[2], p[3], KINDS.index(p[1]), p[6] or 0, p[5] or "", p[7] or 0))
        assert r["count"] == len(own) and r.kinds == sorted({p[1] for p in own})
        assert [(x.kind, x.file, x.sheet, x.header, x.key, x.row, x.col) for x in r.first] == [p[1:] for p in own[:2]]
    assert {r.kind: (r.tokens, r.places) for r in tokens_by_kind(found).collect()} == {k: (len({p[0] for p in want if p[1] == k}), sum(p[1] == k for p in want)) for k in {p[1] for p in want}}


def test_tables_are_one_scan(spark):
    a = spark.createDataFrame([(1, "FooBar", 2.0), (2, None, 3.0)], "id int, NameOf string, x double")
    b = spark.createDataFrame([("Key_One", "FooBar, BarFoo")], "`odd.key` string, `the text` string")
    got = sorted(((r.token, r.kind, r.sheet, r.header, r.key, r.col) for r in places(cells_of_tables({"a": a, "TableTwo": b, "c": a.drop("NameOf")}, "f")).collect()), key=str)
    assert got == sorted([
        ("FooBar", "cell", "a", "NameOf", "1", 2), ("NameOf", "header", "a", "NameOf", None, 2), ("Key_One", "kv-key", "TableTwo", "odd.key", "Key_One", 1), ("FooBar", "cell", "TableTwo", "the text", "Key_One", 2),
        ("BarFoo", "cell", "TableTwo", "the text", "Key_One", 2), ("TableTwo", "sheet", "TableTwo", None, None, None),
    ], key=str)


def test_hot_token_is_cut_before_the_shuffle(spark):
    rows = spark.range(5000).selectExpr("'BookOne' AS file", "'s' AS sheet", "CAST(id + 3 AS INT) AS row", "2 AS col", "'FooBar x' AS value").repartition(5)
    out = index(places(cells_of_sheets(rows)), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    hot = {r.token: r for r in out.collect()}["FooBar"]
    assert hot["count"] == 5000 and [p.row for p in hot.first] == [3, 4, 5]


def test_no_cells(spark):
    none = spark.createDataFrame([], "file string, sheet string, row int, col int, value string")
    assert index(places(cells_of_sheets(none))).count() == 0 and tokens_by_kind(places(cells_of_sheets(none))).count() == 0
