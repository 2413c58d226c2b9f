"""Queries of the typed-table engine: specs, catalog, enumerations and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import catalog, spec

from .book import query

_REVENUE = {
    "table": "lineitem",
    "joins": [{"table": "orders", "on": ["l_orderkey", "o_orderkey"]}, {"table": "customer", "on": ["o_custkey", "c_custkey"]}, {"table": "nation", "on": ["c_nationkey", "n_nationkey"]}],
    "filters": [{"column": "l_shipdate", "op": ">=", "value": "1997-01-01 00:00:00"}],
    "aggregation": {"group_by": ["nation.n_name"], "measures": [{"func": "SUM", "column": "l_quantity", "alias": "quantity"}, {"func": "COUNT", "column": "*", "alias": "n"}, {"func": "MAX", "column": "l_extendedprice", "alias": "top"}]},
    "order_by": [{"column": "nation.n_name"}],
}


@query("""SELECT n_name, sum(l_quantity) AS quantity, count(*) AS n, max(l_extendedprice) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY n_name""")
def spec_revenue_by_nation(t):
    return spec.run(_REVENUE, t)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def spec_projection(t):
    return spec.run({"table": "customer", "columns": ["c_custkey", "c_name", "c_acctbal"], "filters": [{"column": "c_mktsegment", "op": "=", "value": "BUILDING"}, {"column": "c_acctbal", "op": ">", "value": "100"}], "order_by": [{"column": "c_acctbal", "direction": "DESC"}, {"column": "c_custkey"}]}, t)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_name ILIKE '%RED%' AND p_size IN (1, 5, 11, 28) AND p_brand <> 'Brand#2'")
def spec_like_in_unlike(t):
    return spec.unlimited({"table": "part", "filters": [{"column": "p_name", "op": "LIKE", "value": "%RED%"}, {"column": "p_size", "op": "IN", "value": [1, "5", 11, 28, "x"]}, {"column": "p_brand", "op": "!=", "value": "Brand#2"}]}, t)


@query("SELECT count(*) AS total_matched FROM part WHERE false")
def spec_unreadable_value(t):
    return spec.total_matched({"table": "part", "filters": [{"column": "p_size", "op": "<", "value": "many"}]}, t)


@query("SELECT sum(o_totalprice) IS NOT NULL AS ok, count(*) AS n, min(o_orderkey) AS low FROM orders WHERE o_orderpriority IS NOT NULL")
def spec_global_aggregate(t):
    out = spec.run({"table": "orders", "filters": [{"column": "o_orderpriority", "op": "IS NOT NULL"}], "aggregation": {"measures": [{"func": "SUM", "column": "o_totalprice", "alias": "s"}, {"func": "COUNT", "column": "*", "alias": "n"}, {"func": "MIN", "column": "o_orderkey", "alias": "low"}]}}, t)
    return out.select(F.col("s").isNotNull().alias("ok"), "n", "low")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def spec_star_join(t):
    return spec.unlimited({"table": "supplier", "joins": [{"table": "nation", "on": ["s_nationkey", "n_nationkey"]}]}, t)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def spec_rest_filters(t):
    return spec.run({"table": "orders", "columns": ["o_orderkey", "o_totalprice"], "filters": spec.filters_of("o_totalprice>=1000,o_orderstatus=F"), "order_by": [{"column": "o_orderkey"}], "limit": 9999}, t)


@query("SELECT count(*) AS total_matched FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05")
def spec_total(t):
    return spec.total_matched({"table": "lineitem", "filters": [{"column": "l_quantity", "op": "<", "value": 24}, {"column": "l_discount", "op": ">=", "value": 0.05}], "limit": 5}, t)


@query("SELECT table_name, CAST(count(*) AS INTEGER) AS column_count FROM information_schema.columns WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations') GROUP BY table_name")
def catalog_tables(t):
    return catalog.list_tables(catalog.catalog(t.spark, t.all())).select("table_name", "column_count")


@query("SELECT 'orders' AS table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS name FROM information_schema.columns WHERE table_name = 'orders'")
def catalog_describe(t):
    return catalog.describe(catalog.catalog(t.spark, t.all()), "orders").select("table_name", "position", "name")


@query("""WITH m AS (SELECT DISTINCT 'status' AS enum_type, o_orderstatus AS name FROM orders UNION SELECT DISTINCT 'priority', o_orderpriority FROM orders)
SELECT enum_type, name, CAST(row_number() OVER (PARTITION BY enum_type ORDER BY name) - 1 AS INTEGER) AS value, '' AS comment FROM m""")
def enum_members(t):
    return catalog.enums_of(t.orders, {"o_orderstatus": "status", "o_orderpriority": "priority"})


@query("""WITH m AS (SELECT o_orderpriority AS name, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT code, count(*) AS n FROM orders JOIN m ON o_orderpriority = name GROUP BY code""")
def enum_decode(t):
    members = catalog.enums_of(t.orders, {"o_orderpriority": "priority"})
    return catalog.decode_enum(t.orders, members, "o_orderpriority", "priority", "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (VALUES ('lineitem','orderkey','orders'), ('lineitem','partkey','part'), ('lineitem','suppkey','supplier'), ('orders','custkey','customer'), ('customer','nationkey','nation'), ('supplier','nationkey','nation'), ('nation','regionkey','region'))
v(source_table, source_column, target_table)""")
def foreign_keys(t):
    columns = catalog.all_columns(catalog.catalog(t.spark, t.all())).withColumn("name", F.regexp_replace("name", "^[a-z]+_", "")).where("name like '%key'")
    registry = t.spark.createDataFrame([(n,) for n in t.all()], "table_name string")
    edges = catalog.foreign_keys(columns, registry, patterns=("{base}", "{base}s", "{base}omer", "{base}lier"), suffix="key")
    return edges.select("source_table", "source_column", "target_table")


@query("""SELECT 'table' AS kind, table_name AS name, CAST(count(*) AS VARCHAR) AS detail FROM information_schema.columns WHERE table_name IN ('lineitem','pages','region','nation','customer','supplier','part','orders','events','documents','embeddings','benchmark','labels','conversations') AND table_name LIKE '%or%' GROUP BY table_name
UNION ALL SELECT DISTINCT 'enum', c_mktsegment, 'segment' FROM customer WHERE lower(c_mktsegment) LIKE '%or%'""")
def catalog_search(t):
    members = catalog.enums_of(t.customer, {"c_mktsegment": "segment"})
    return catalog.search_catalog(catalog.catalog(t.spark, t.all()), members, "OR")


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def distinct_by_group(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))
