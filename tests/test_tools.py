import pytest

from quarry.search import tools

ROWS = [(i, f"name {i}" if i % 5 else None, ("the cat sat " * (i % 4) + f"on_mat {i}") if i % 7 else None, [float(i), 1.0] if i % 3 else None) for i in range(40)] + [(None, "null id", "the cat sat ", [0.0, 0.0])]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, text string, embedding array<double>").repartition(3)
    df.createOrReplaceTempView("rows_of_tools")
    tools.register(spark)
    return df


def test_five_tools_in_sql(spark, rows):
    best = lambda call, n: [(r.id, r.score) for r in spark.sql(f"SELECT * FROM {call} ORDER BY score DESC, id NULLS LAST LIMIT {n}").collect()]
    held = sorted(((-float(t.count("cat")), i is None, i) for i, _, t, _ in ROWS if t and "cat" in t))
    assert best("find_text(rows => TABLE(rows_of_tools), keyword => 'cat', limit => 7)", 7) == [(i, -s) for s, _, i in held[:7]]
    named = spark.sql("SELECT * FROM find_name(query => 'ne 3', rows => TABLE(rows_of_tools))").collect()
    assert named and all(r.found == r.name and "3" in r.name for r in named)
    assert best("find_phrases(rows => TABLE(rows_of_tools), phrases => array('cat sat', 'on_mat 9'), limit => 500)", 1) == [(9, 1.0)]
    assert {i for i, _ in best("find_terms(TABLE(rows_of_tools), query => 'cat 13', least => 0.9)".replace("TABLE", "rows => TABLE"), 99)} == {13}
    near = best("find_vectors(rows => TABLE(rows_of_tools), vector => array(1D, 0D), limit => 3)", 3)
    assert [i for i, _ in near] == [38, 37, 35] and near[0][1] > 0.99


@pytest.mark.parametrize(
    ("call", "says"),
    [
        ("find_text(rows => TABLE(rows_of_tools))", "missing argument keyword"), ("find_text(rows => TABLE(rows_of_tools), keyword => 5)", "keyword must be of type string"), ("find_text(rows => TABLE(rows_of_tools), keyword => '')", "must not be empty"),
        ("find_text(rows => TABLE(rows_of_tools), keyword => 'x', depth => 2)", "unknown argument depth"), ("find_text(rows => TABLE(rows_of_tools), keyword => 'x', limit => 0)", "limit must lie between 1 and 500"), ("find_text(rows => TABLE(rows_of_tools), keyword => 'x', case => 'upper')", "must be one of exact, any"),
        ("find_phrases(rows => TABLE(rows_of_tools), phrases => array('x', ''))", "holds an item"), ("find_terms(rows => TABLE(rows_of_tools), query => 'x', least => 1.5)", "least must lie"), ("find_text(keyword => 'x')", "needs rows"),
        ("find_text(rows => TABLE(SELECT id, name FROM rows_of_tools), keyword => 'x')", "column text"), ("find_vectors(rows => TABLE(rows_of_tools), vector => 'x')", "type array"), ("find_text(rows => TABLE(SELECT *, 1 AS score FROM rows_of_tools), keyword => 'x')", "already"),
    ],
)
def test_wrong_arguments_are_refused_before_the_job(spark, rows, call, says):
    with pytest.raises(Exception, match=says):  # by analysis: no action is called
        spark.sql(f"SELECT * FROM {call}").schema


def test_calls_by_name(spark, rows):
    got = tools.call(rows, "find_text", {"keyword": "it's \\ 'x'"})
    assert got.count() == 0 and got.columns == [*rows.columns, "score", "found"]
    assert [r.id for r in tools.call(rows.where("id is not null"), "find_text", {"keyword": "cat", "limit": 3}).collect()] == [3, 11, 15]
    for name, arguments in (("no_tool", {}), ("find_text", {"word": "x"}), ("find_vectors", {"vector": []}), ("find_vectors", {"vector": [True]}), ("find_terms", {"query": "a", "least": float("nan")})):
        with pytest.raises(ValueError):
            tools.call(rows, name, arguments)
    assert all(t.schema["type"] == "object" and t.description for t in tools.TOOLS.values())
    assert tools.call(rows.where("false"), "find_text", {"keyword": "x"}).count() == 0
