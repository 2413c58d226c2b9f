"""Workbooks as a Spark data source: ``spark.read.format("xlsx")`` gives cells, a partition for each workbook.

Rows: file, sheet, row and col from 1, value as text. Options: ``files`` (a list, one path a line), ``sheets`` (names
to read, by commas; all without it), ``skip`` (names to leave out).
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry import catalog

SCHEMA = "file string, sheet string, row int, col int, value string"
#: Sheets that hold no table.
SKIPPED = ("Info", "#Common#")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read_cells(file: str, data: bytes, only: list[str], skip: list[str]):
    """(file, sheet, row, col, value) of a workbook's cells that aren't empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name = sheet.get("name")
            if (only and name not in only) or name in skip:
                continue
            target = links[sheet.get(_LINK)].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag == f"{_MAIN}c":
                        kind, value = node.get("t", "n"), node.find(f"{_MAIN}v")
                        text = _text(node) if kind == "inlineStr" else value.text if value is not None else None
                        if kind == "s" and text is not None:
                            text = shared[int(text)]
                        if text not in (None, ""):
                            ref = node.get("r")
                            yield file, name, int(re.search(r"\d+", ref)[0]), _column(ref), text
                    elif node.tag == f"{_MAIN}row":
                        node.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for f in (options.get("files") or options.get("path") or "").split("\n") if f]
        self.only = [s for s in options.get("sheets", "").split(",") if s]
        self.skip = [s for s in options.get("skip", ",".join(SKIPPED)).split(",") if s]

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition):
        with open(partition.path.removeprefix("file://"), "rb") as f:
            yield from read_cells(partition.path, f.read(), self.only, self.skip)


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def cells(spark: SparkSession, path: str, sheets: list[str] | None = None, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Cells of all workbooks under a path, in any store that Spark reads; a workbook is one task's work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    only, left_out = list(sheets or []), list(skip)

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(read_cells(file, data, only, left_out))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "sheet", "row", "col", "value"])

    return files.mapInArrow(read, SCHEMA)


def table_columns(cells: DataFrame) -> DataFrame:
    """(file, sheet, col, name, meta): columns by the header row and the ``key=value`` lines of the second row; blank headers inside are named ``_col{i}``."""
    heads = cells.where("row <= 2").groupBy("file", "sheet", "col").agg(F.max(F.when(F.col("row") == 1, F.trim("value"))).alias("name"), F.max(F.when(F.col("row") == 2, F.col("value"))).alias("meta"))
    width = heads.where("name <> ''").groupBy("file", "sheet").agg(F.max("col").alias("last"))
    every = width.select("file", "sheet", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("col"))
    heads = every.join(heads, ["file", "sheet", "col"], "left")
    return heads.select("file", "sheet", "col", F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat(F.lit("_col"), (F.col("col") - 1).cast("string"))).alias("name"), catalog.parse_meta(F.col("meta")).alias("meta"))


def table(cells: DataFrame, sheet: str, file: str | None = None) -> DataFrame:
    """A sheet as a typed table: rows from the third on, without empty rows and rows whose ``Disable`` is set; short rows are filled with nulls."""
    own = cells.where(F.col("sheet") == sheet)
    own = own if file is None else own.where(F.col("file") == file)
    heads = table_columns(own).orderBy("col").collect()  # a sheet's columns, 16384 at most
    facts = [catalog.column_fact(h["name"], dict(h["meta"])) for h in heads]
    rows = own.where("row >= 3").groupBy("file", "row").agg(*[F.max(F.when(F.col("col") == h["col"], F.col("value"))).alias(h["name"]) for h in heads])
    rows = rows.where(F.coalesce(*[F.col(f"`{h['name']}`") for h in heads]).isNotNull())
    if any(h["name"] == "Disable" for h in heads):
        rows = rows.where(~F.coalesce(F.lower(F.trim("Disable")).isin("1", "true", "yes", "1.0"), F.lit(False)))
    return catalog.typed(rows, facts)


def enums(cells: DataFrame) -> DataFrame:
    """(enum_type, name, value, comment): members of workbooks named after their enumeration, from the second row on."""
    kind = F.regexp_extract("file", r"([^/\\]+)\.xlsx$", 1)
    at = lambda c: F.max(F.when(F.col("col") == c, F.trim("value")))
    rows = cells.where("row >= 2").groupBy("file", "sheet", "row").agg(at(1).alias("name"), at(2).alias("value"), at(3).alias("comment"))
    return rows.where("coalesce(name, '') <> ''").select(kind.alias("enum_type"), "name", F.col("value").try_cast("double").try_cast("int").alias("value"), F.coalesce("comment", F.lit("")).alias("comment"))
