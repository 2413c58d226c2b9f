from quarry.documents.headed import headed_tables, markdown_rows

CELLS, MERGES = "sheet string, row int, col int, value string", "sheet string, min_row int, min_col int, max_row int, max_col int"


def grid(name, text, first_row=1):
    """Cells of lines of ``a . b``: dots are empty."""
    return [(name, first_row + r, c + 1, v) for r, line in enumerate(text.strip("\n").split("\n")) for c, v in enumerate(line.split()) if v != "."]


def found(spark, cells, merges=()):
    parts, data = headed_tables(spark.createDataFrame(cells, CELLS).repartition(3), spark.createDataFrame(list(merges), MERGES))
    columns = {}
    for r in sorted(parts.collect(), key=lambda r: (r.sheet, r.start, r.part, r.col)):
        columns.setdefault((r.sheet, r.start, r.part), []).append((r.name, r.label, tuple(r.groups) if r.groups else None))
    values = {}
    for r in sorted(data.collect(), key=lambda r: (r.sheet, r.start, r.part, r.row, r.col)):
        values.setdefault((r.sheet, r.start, r.part), {}).setdefault(r.row, []).append(r.value)
    return columns, values


def names(columns, key):
    return "".join(n for n, *_ in columns[key])


def test_one_header_and_what_follows_in_the_band(spark):
    text = """
title
A B C
1 2 3
4 . 6
. . . . x
D E F
7 8 9
. . .
G H
I J K
"""
    columns, values = found(spark, grid("s", text))
    # the row of x has nothing under the header, so the table ends; D E F heads the next one; I J K has no data
    assert sorted(columns) == [("s", 2, 0), ("s", 6, 0)]
    assert names(columns, ("s", 2, 0)) == "ABC" and names(columns, ("s", 6, 0)) == "DEF"
    assert values == {("s", 2, 0): {3: ["1", "2", "3"], 4: ["4", "6"]}, ("s", 6, 0): {7: ["7", "8", "9"]}}


def test_group_headers_over_merged_cells(spark):
    text = """
G1 . . G2 . G3
a b c d e f
1 2 3 4 5 6
"""
    columns, values = found(spark, grid("s", text), [("s", 1, 1, 1, 3), ("s", 1, 4, 1, 5)])
    assert names(columns, ("s", 1, 0)) == "abcdef" and columns["s", 1, 0][0][2] == ("G1", "G2", "G3")
    assert values["s", 1, 0] == {3: list("123456")}


def test_parallel_tables(spark):
    text = """
Left . . . Right
a b c . d e f g
1 2 3 . 4 5 6 7
. . . . 8 9 . .
5 5 5 . . . . .
"""
    columns, values = found(spark, grid("s", text))
    assert names(columns, ("s", 2, 0)) == "abc" and names(columns, ("s", 2, 1)) == "defg"
    assert {x[1] for x in columns["s", 2, 0]} == {"Left"} and {x[1] for x in columns["s", 2, 1]} == {"Right"}
    assert values == {("s", 2, 0): {3: ["1", "2", "3"], 5: ["5", "5", "5"]}, ("s", 2, 1): {3: ["4", "5", "6", "7"], 4: ["8", "9"]}}


def test_parallel_tables_under_group_headers(spark):
    text = """
*One . . . *Two . . . *Three
a b c . d e f . g h i
1 2 3 . 4 5 6 . 7 8 9
"""
    columns, values = found(spark, grid("s", text))
    assert [columns["s", 1, p][0][1] for p in range(3)] == ["One", "Two", "Three"] and values["s", 1, 2] == {3: ["7", "8", "9"]}


def test_clusters_of_unlike_sizes_are_one_table(spark):
    columns, values = found(spark, grid("s", "a b c . d e f g h\n1 2 3 . 4 5 6 7 8"))
    assert names(columns, ("s", 1, 0)) == "abcdefgh" and values == {("s", 1, 0): {2: list("12345678")}}


def test_merged_rows_and_sections(spark):
    text = """
. a b c
. 1 x y
. . . .
. 2 z .
▶next 9 9 9
. d e f
. 3 3 3
"""
    # a value that is merged over two rows counts in both; a row that only continues merged cells is none
    columns, values = found(spark, grid("s", text), [("s", 2, 2, 3, 2), ("s", 2, 3, 3, 3), ("s", 4, 2, 4, 3)])
    assert values["s", 1, 0] == {2: ["1", "x", "y"], 4: ["2", "z"]}
    assert names(columns, ("s", 5, 0)) == "▶next999" and values["s", 5, 0] == {6: ["d", "e", "f"], 7: ["3", "3", "3"]}


def test_edges(spark):
    rows = [("n", 1, 1, None), ("n", 1, 2, " "), ("n", 2, 1, "a"), ("t", 1, 1, "a"), ("t", 1, 1, "b"), ("t", 1, 2, "c"), ("t", 1, 3, "d"), ("t", 2, 3, "e|f\ng")]
    columns, values = found(spark, rows)
    assert list(columns) == [("t", 1, 0)] and names(columns, ("t", 1, 0)) == "acd" and values == {("t", 1, 0): {2: ["e|f\ng"]}}
    parts, data = headed_tables(spark.createDataFrame(rows, CELLS), spark.createDataFrame([], MERGES))
    assert [r.line for r in markdown_rows(parts, data).orderBy("row").collect()] == ["| a | c | d |", "| --- | --- | --- |", "|  |  | e∣f / g |"]
    assert found(spark, []) == ({}, {})
