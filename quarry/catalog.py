"""Facts about typed tables: columns, enumerations and foreign keys, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of a sheet's second row.
TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "float": T.DoubleType(), "float32": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType()}
#: Names that a column ``<base>Id`` may point to, in order.
KEY_TARGETS = ("{base}Class", "{base}", "{base}Group")

COLUMN_FACTS = "name string, sql_type string, domain string, raw_type string, default string, is_array boolean, is_enum boolean, enum_name string"


def parse_meta(cell: Column) -> Column:
    """``key=value`` lines of a cell as a map with keys in lower case; null and empty cells give an empty map."""
    lines = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.contains("="))
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))), F.trim(F.substr(x, F.instr(x, "=") + 1)))
    latest = F.aggregate(lines, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda e: e["k"] != F.lower(F.trim(F.substring_index(x, "=", 1)))), F.array(pair(x).cast("struct<k:string,v:string>"))))
    return F.map_from_entries(latest)


def column_fact(name: str, meta: dict[str, str]) -> dict:
    """Type facts of one column; a type name that isn't known is the name of an enumeration."""
    raw = (meta.get("type") or "string").strip()
    known = TYPES.get(raw.lower())
    return {
        "name": name, "sql_type": (known or T.StringType()).simpleString(), "domain": meta.get("domain", ""), "raw_type": raw, "default": meta.get("default", ""),
        "is_array": meta.get("array", "").strip().lower() == "true", "is_enum": known is None, "enum_name": "" if known else raw,
    }


def schema_of(facts: list[dict]) -> T.StructType:
    """A schema whose fields carry their facts as metadata; arrays keep their text, and are parsed by ``typed``."""
    return T.StructType([T.StructField(f["name"], T.StringType(), metadata=f) for f in facts])


def typed(df: DataFrame, facts: list[dict]) -> DataFrame:
    """Text columns cast to their types (null where the text doesn't fit); arrays by commas."""
    out = []
    for f in facts:
        c = F.col(f"`{f['name']}`")
        if f["is_array"]:
            value = _array(c, f["sql_type"])
        elif f["sql_type"] == "boolean":
            value = F.lower(F.trim(c)).isin("1", "true", "1.0")
        elif f["sql_type"] in ("int", "bigint"):
            value = F.trim(c).try_cast("decimal(38,6)").try_cast(f["sql_type"])
        else:
            value = c if f["sql_type"] == "string" else F.trim(c).try_cast(f["sql_type"])
        out.append(value.alias(f["name"], metadata=f))
    return df.select(*out)


def _array(c: Column, item: str) -> Column:
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast(item))


def table_facts(name: str, df: DataFrame) -> list[dict]:
    """Facts of each column: those in its metadata, or else read off its type."""
    out = []
    for field in df.schema.fields:
        meta = field.metadata or {}
        out.append({k: meta.get(k, v) for k, v in {
            "name": field.name, "sql_type": field.dataType.simpleString(), "domain": "", "raw_type": field.dataType.simpleString(), "default": "",
            "is_array": isinstance(field.dataType, T.ArrayType), "is_enum": False, "enum_name": "",
        }.items()})
    return out


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, number of columns, and their facts."""
    rows = [(name, len(df.columns), table_facts(name, df)) for name, df in tables.items()]
    return spark.createDataFrame(rows, f"table_name string, column_count int, columns array<struct<{COLUMN_FACTS.replace(' string', ':string').replace(' boolean', ':boolean')}>>")


def list_tables(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("table_name")


def describe(catalog: DataFrame, table: str) -> DataFrame:
    return catalog.where(F.col("table_name") == table).select("table_name", F.posexplode("columns").alias("position", "c")).select("table_name", "position", "c.*")


def all_columns(catalog: DataFrame) -> DataFrame:
    return catalog.select("table_name", F.posexplode("columns").alias("position", "c")).select("table_name", "position", "c.*")


def lookup_enum(enums: DataFrame, enum_type: str) -> DataFrame:
    """Members of an enumeration by value; without a value first."""
    return enums.where(F.col("enum_type") == enum_type).orderBy(F.asc_nulls_first("value"), "name")


def enums_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """An enumeration for each column of ``columns`` (column, enumeration's name): its distinct values, numbered from 0 by name."""
    parts = F.array(*[F.struct(F.lit(e).alias("enum_type"), F.col(c).cast("string").alias("name")) for c, e in columns.items()])
    members = df.select(F.explode(parts).alias("e")).select("e.*").where("name is not null").distinct()
    return members.withColumn("value", (F.row_number().over(W.partitionBy("enum_type").orderBy("name")) - 1).cast("int")).withColumn("comment", F.lit(""))


def decode_enum(df: DataFrame, enums: DataFrame, column: str, enum_type: str, out: str) -> DataFrame:
    """Adds an enumeration's value for the column's name; null where it has no such member."""
    members = enums.where(F.col("enum_type") == enum_type).select(F.col("name").alias(column), F.col("value").alias(out)).dropDuplicates([column])
    return df.join(members, column, "left")


def search_catalog(catalog: DataFrame, enums: DataFrame, word: str, limit: int = 20) -> DataFrame:
    """Tables whose name, and enumeration members whose name or comment, contains the word; (kind, name, detail)."""
    word = word.lower()
    found = catalog.where(F.lower("table_name").contains(word)).select(F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.col("column_count").cast("string").alias("detail"))
    members = enums.where(F.lower("name").contains(word) | F.lower(F.coalesce("comment", F.lit(""))).contains(word))
    return found.unionByName(members.select(F.lit("enum").alias("kind"), "name", F.col("enum_type").alias("detail"))).orderBy("kind", "name", "detail").limit(limit)


def foreign_keys(columns: DataFrame, registry: DataFrame, patterns: tuple[str, ...] = KEY_TARGETS, suffix: str = "Id") -> DataFrame:
    """Edges from columns named ``<base><suffix>`` to the first registered table among the patterns, and from columns of an enumeration to it.

    ``columns``: table_name, name, is_enum, enum_name; ``registry``: table_name.
    """
    base = F.left("name", F.length("name") - len(suffix))
    asked = columns.where(F.col("name").endswith(suffix) & (F.length("name") > len(suffix)) & ~F.col("is_enum"))
    named = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p.split("{base}")[0]), base, F.lit(p.split("{base}")[1])).alias("target_table")) for i, p in enumerate(patterns)])
    tried = asked.select("table_name", "name", F.explode(named).alias("t")).select("table_name", "name", "t.*")
    known = tried.join(registry.select(F.col("table_name").alias("target_table")).distinct(), "target_table").where("target_table <> table_name")
    best = known.groupBy("table_name", "name").agg(F.min(F.struct("rank", "target_table")).alias("b"))
    edges = best.select(F.col("table_name").alias("source_table"), F.col("name").alias("source_column"), F.col("b.target_table").alias("target_table"), F.lit("Id").alias("target_column"), F.lit("fk").alias("relation_type"))
    enums = columns.where("is_enum and enum_name <> ''").select(F.col("table_name").alias("source_table"), F.col("name").alias("source_column"), F.col("enum_name").alias("target_table"), F.lit("name").alias("target_column"), F.lit("enum").alias("relation_type"))
    return edges.unionByName(enums)


def content_hash(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substr(F.sha2(content, 256), F.lit(1), F.lit(16))
