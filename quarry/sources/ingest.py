"""A folder of workbooks as stored tables with their catalog, enumerations and keys."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import catalog
from quarry.sources import xlsx

#: The workbook that registers tables, and the folder of enumerations.
REGISTRY, ENUM_FOLDER = "TableAttribute.xlsx", "Enum"
REPORT = "file string, sheet string, table_name string, column_count int, row_count bigint, registered boolean, status string"


#: Tables that are written at one time.
AT_ONCE = 16


def registry(cells: DataFrame) -> DataFrame:
    """(table_name, cs, only_schema): tables of the registry's cells, a row each from the second on; ``cs`` is ``cs`` where it is left out.

    A name given twice is what its last row says. Empty cells give no rows.
    """
    at = lambda c: F.max(F.when(F.col("col") == c, F.trim("value")))
    rows = cells.where(F.col("file").endswith(REGISTRY) & (F.col("row") >= 2)).groupBy("row").agg(at(1).alias("table_name"), at(2).alias("cs"), at(3).alias("only"))
    set_ = ~F.coalesce(F.lower("only"), F.lit("")).isin("", "0", "0.0", "false")
    rows = rows.where("coalesce(table_name, '') <> ''").select("row", "table_name", F.coalesce("cs", F.lit("cs")).alias("cs"), set_.alias("only_schema"))
    return rows.groupBy("table_name").agg(F.max_by("cs", "row").alias("cs"), F.max_by("only_schema", "row").alias("only_schema"))


def stored_name(sheet: str) -> str:
    """A sheet's name as a table's: letters, digits and underscores."""
    return re.sub("[^a-zA-Z0-9_]", "_", sheet)


def ingest(spark: SparkSession, folder: str, into: str, dry_run: bool = False) -> DataFrame:
    """Every sheet of a folder's workbooks as a typed table below ``into``; gives the report, a row for each sheet.

    Cells are read once, to ``into/_cells`` by sheet. Tables go to ``into/<table>``; ``_catalog``, ``_enums``, ``_keys``,
    ``_registry`` and ``_report`` stand beside them. Of sheets whose tables would have one name the first by file and
    sheet is stored; the others are reported as ``duplicate``. Sheets without a header are left out. A dry run stores
    cells and the report only. An empty folder gives an empty report.
    """
    read = xlsx.cells(spark, folder)
    read.write.mode("overwrite").partitionBy("sheet").option("compression", "zstd").parquet(f"{into}/_cells")
    cells = spark.read.schema(xlsx.SCHEMA).option("basePath", f"{into}/_cells").parquet(f"{into}/_cells")
    is_enum = F.col("file").contains(f"/{ENUM_FOLDER}/")
    known = registry(cells)
    own = cells.where(~is_enum & ~F.col("file").endswith(REGISTRY))
    counts = own.where("row >= 3").groupBy("file", "sheet").agg(F.count_distinct("row").alias("filled"))
    found = xlsx.table_columns(own).groupBy("file", "sheet").agg(F.count(F.lit(1)).cast("int").alias("column_count")).join(counts, ["file", "sheet"], "left")
    registered = known.select(F.col("table_name").alias("sheet"), F.lit(True).alias("registered"))
    sheets = found.join(registered, "sheet", "left").orderBy("file", "sheet").collect()  # facts of a row for each sheet, not of its cells
    seen, plan, tables = set(), [], {}
    for s in sheets:
        name = stored_name(s["sheet"])
        plan.append((s, name, "duplicate" if name.lower() in seen else "parsed" if dry_run else "stored"))
        seen.add(name.lower())

    def store(part):
        s, name, status = part
        n = s["filled"] or 0
        if status == "stored":
            xlsx.table(own, s["sheet"], s["file"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{into}/{name}")
            tables[name] = spark.read.parquet(f"{into}/{name}")
            n = tables[name].count()
        return (s["file"], s["sheet"], name, s["column_count"], n, bool(s["registered"]), status)

    # tables have schemas of their own, so each is a write; many small ones are under way at once
    with ThreadPoolExecutor(AT_ONCE) as pool:
        report = list(pool.map(store, plan))
    tables = {name: tables[name] for _, name, status in plan if status == "stored"}
    result = spark.createDataFrame(report, REPORT)
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{into}/{name}")
    save(result, "_report")
    if not dry_run:
        facts = catalog.catalog(spark, tables)
        more = result.where("status = 'stored'").join(known.select(F.col("table_name").alias("sheet"), "cs"), "sheet", "left")
        save(facts.join(more.select("table_name", "file", "sheet", "row_count", F.coalesce("cs", F.lit("cs")).alias("cs")), "table_name"), "_catalog")
        members = xlsx.enums(cells.where(is_enum))
        save(members.dropDuplicates(["enum_type", "name"]), "_enums")
        save(catalog.foreign_keys(catalog.all_columns(facts), known), "_keys")
        save(known, "_registry")
    return spark.read.schema(REPORT).parquet(f"{into}/_report")


def totals(report: DataFrame) -> DataFrame:
    """One row: tables stored, their rows, and sheets that the registry doesn't name."""
    stored = F.col("status") == "stored"
    return report.agg(F.count_if(stored).alias("tables_created"), F.coalesce(F.sum(F.when(stored, F.col("row_count"))), F.lit(0)).alias("total_rows"), F.count_if(~F.col("registered")).alias("unregistered_sheets"))
