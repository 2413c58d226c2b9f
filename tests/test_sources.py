import json
import zipfile

from pyspark.sql import functions as F

from quarry import catalog
from quarry.sources import files, xlsx

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _name(col):
    return (_name(col // 26 - 1) if col >= 26 else "") + chr(65 + col % 26)


def write_workbook(path, sheets, shared=False):
    """A workbook of text cells; None leaves a cell out."""
    strings = []
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets)) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = ""
            for y, row in enumerate(rows):
                cells = ""
                for x, v in enumerate(row):
                    ref = f"{_name(x)}{y + 1}"
                    if isinstance(v, int | float):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v is not None and shared:
                        strings.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                body += f'<row r="{y + 1}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"{_HEAD}<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"{_HEAD}<sst {_MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")


def test_typed_table(spark, tmp_path):
    rows = [
        ["Id", "Name", None, "Kind", "Tags", "Disable", None], ["type=int32", "type=string\ndomain=cs", None, "type=ItemKind", "type=int32\narray=TRUE", "type=bool", None],
        [1, "a", "x", "Sword", "1,2", None, None], [None] * 7, [2, "b", None, None, None, 1, None], [3], ["?", "d"],
    ]
    write_workbook(tmp_path / "Items.xlsx", {"Info": [["no"]], "Item": rows}, shared=True)
    cells = xlsx.cells(spark, str(tmp_path))
    assert {r.sheet for r in cells.select("sheet").distinct().collect()} == {"Item"}
    out = xlsx.table(cells, "Item")
    assert out.columns == ["Id", "Name", "_col2", "Kind", "Tags", "Disable"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "x", "Sword", [1, 2], None), (3, None, None, None, None, None), (None, "d", None, None, None, None)], key=str)
    facts = {f["name"]: f for f in catalog.table_facts("Item", out)}
    assert facts["Kind"]["is_enum"] and facts["Name"]["domain"] == "cs" and facts["Tags"]["is_array"]


def test_enums_and_source(spark, tmp_path):
    write_workbook(tmp_path / "Color.xlsx", {"S": [["Name", "Value", "Comment"], ["Red", 1, "hot"], ["None"], ["", 5]]})
    got = {tuple(r) for r in xlsx.enums(xlsx.cells(spark, str(tmp_path))).collect()}
    assert got == {("Color", "Red", 1, "hot"), ("Color", "None", None, "")}
    spark.dataSource.register(xlsx.XlsxSource)
    read = spark.read.format("xlsx").option("files", str(tmp_path / "Color.xlsx")).load()
    assert read.count() == 8 and read.columns == ["file", "sheet", "row", "col", "value"]


def test_pages_and_tables(spark, tmp_path):
    for folder, name, text in (("a", "content.md", "x" * 60), ("a", "content_enriched.md", "y" * 60), ("b", "content.md", "z" * 60), ("c", "content.md", "short")):
        (tmp_path / "w" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / folder / name).write_text(text)
    got = sorted(r.text[0] for r in files.preferred_pages(files.whole_texts(spark, str(tmp_path / "w"))).collect())
    assert got == ["y", "z"]
    found = {"source_file": "B.xlsx", "sheet_name": "S", "tables": [{"table_id": "t1", "table_name": "Drop rates", "description": "how often", "headers": [{"name": "a"}, {"name": "b"}], "rows": [["1", None]], "sample_queries": ["what drops"], "notes": ""}]}
    (tmp_path / "foundation_tables.json").write_text(json.dumps(found))
    tables = files.foundation_tables(spark, str(tmp_path / "foundation_tables.json"))
    assert tables.first().text.startswith("### Drop rates\nhow often\na | b\n1 | ")
    assert files.table_hits(tables, "OFTEN").first()["rank"] == 2 and files.table_hits(tables, "what").first().snippet == "what drops" and files.table_hits(tables, "zz").count() == 0


def test_graph_and_lines(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"meta": {}, "systems": {"A": {"related_systems": ["B", "C"], "tables": 2}, "B": {"related_systems": []}}}))
    nodes, edges = files.graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and {tuple(r) for r in edges.collect()} == {("A", "B"), ("A", "C")}
    files.append_jsonl(spark.createDataFrame([(1, "x")], "id int, s string"), str(tmp_path / "l"))
    files.append_jsonl(spark.createDataFrame([(2, "y")], "id int, s string"), str(tmp_path / "l"))
    (tmp_path / "l" / "bad.json").write_text("{broken\n")
    good, bad = files.read_jsonl(spark, str(tmp_path / "l"), "id int, s string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["{broken"]
    have = spark.createDataFrame([("a",)], "name string")
    assert [r.name for r in files.new_sources(have, spark.createDataFrame([("a",), ("b",)], "name string")).collect()] == ["b"]


def test_foreign_keys(spark):
    columns = spark.createDataFrame([("Quest", "ItemId", False, ""), ("Quest", "NpcId", False, ""), ("Quest", "Kind", True, "QuestKind"), ("Quest", "QuestId", False, ""), ("Quest", "Id", False, "")], "table_name string, name string, is_enum boolean, enum_name string")
    registry = spark.createDataFrame([("Item",), ("ItemClass",), ("NpcGroup",), ("Quest",)], "table_name string")
    got = {(r.source_column, r.target_table, r.relation_type) for r in catalog.foreign_keys(columns, registry).collect()}
    assert got == {("ItemId", "ItemClass", "fk"), ("NpcId", "NpcGroup", "fk"), ("Kind", "QuestKind", "enum")}
    assert spark.range(1).select(catalog.content_hash(F.lit("a"))).first()[0] == "ca978112ca1bbdca"
