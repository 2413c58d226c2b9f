"""Cells are gone through once for counts and once for first places, whatever files and sheets are called."""

from quarry import registry
from quarry.documents import token_scan


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_read_twice_at_most(spark, sf_dir):
    found = registry.queries()
    assert plan(found["token_index"](spark, sf_dir)).count("FileScan parquet [l_orderkey") == 2
    assert plan(found["tokens_of_kinds"](spark, sf_dir)).count("FileScan parquet [l_orderkey") == 1


def test_known_sheets_give_the_same_places(spark):
    rows = spark.createDataFrame([(1, "FooBar MAX_HP aB"), (2, "FooBar"), (3, None), (4, "_ Foo Ab_Cd")], "id int, NameOf string")
    tables = {"FirstSheet": rows, "SecondSheet": rows.where("false"), "HUD": rows.select("id")}
    cells = token_scan.cells_of_tables(tables, "TheBook")
    known = token_scan.places(cells, token_scan.sheets_of_tables(tables, "TheBook"))
    assert sorted(map(str, known.collect())) == sorted(map(str, token_scan.places(cells).collect()))
    got = {r.token: (r["count"], r.kinds, [(x.kind, x.key) for x in r.first]) for r in token_scan.index(known, 2).collect()}
    assert got == {
        "FooBar": (2, ["cell"], [("cell", "1"), ("cell", "2")]), "MAX_HP": (1, ["cell"], [("cell", "1")]), "Ab_Cd": (1, ["cell"], [("cell", "4")]), "NameOf": (2, ["header"], [("header", None)] * 2),
        "TheBook": (1, ["filename"], [("filename", None)]), "FirstSheet": (1, ["sheet"], [("sheet", None)]), "SecondSheet": (1, ["sheet"], [("sheet", None)]),
    }
    assert token_scan.index(known, 0).count() == 0
