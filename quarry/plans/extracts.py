"""Queries over matches with places, JSON in answers, rules as rows, and edges with attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import evaluation
from quarry.functions import json_blocks, places
from quarry.operators import graph, rules

from .book import query


@query("""WITH p AS (SELECT page_id, replace(html, '![', '! [') AS html, '![alt ' || page_id || '](images/p' || page_id || '.png)' AS one, '![](http://x/é.png \"t\")' AS two FROM pages)
SELECT page_id, 'alt ' || page_id AS alt, 'images/p' || page_id || '.png' AS path, length(html)::INTEGER AS start, (length(html) + length(one))::INTEGER AS end FROM p
UNION ALL SELECT page_id, '', 'http://x/é.png "t"', (length(html) + length(one) + 2)::INTEGER, (length(html) + length(one) + 2 + length(two))::INTEGER FROM p""".replace('\\"', '"'))
def image_places(t):
    """References to images behind whole pages, with their places."""
    n = F.col("page_id").cast("string")
    text = F.concat(F.replace("html", F.lit("!["), F.lit("! [")), F.lit("![alt "), n, F.lit("](images/p"), n, F.lit(".png)日 ![](http://x/é.png \"t\")"))
    return t.pages.select("page_id", F.inline(places.image_places(text)))


@query("""SELECT doc_id, x.start AS start, x.start + 5 AS end, 'ation' AS text FROM (SELECT doc_id, unnest(list_transform(range(1, len(parts)), lambda i: {'start': (list_sum(list_transform(parts[1:i], lambda s: length(s))) + 5 * (i - 1))::INTEGER})) AS x
    FROM (SELECT doc_id, string_split(text, 'ation') AS parts FROM documents))""")
def match_places(t):
    """Places of a piece in all documents."""
    return t.documents.select("doc_id", F.inline(places.matches(F.col("text"), "ation")))


@query("""SELECT doc_id, i::INTEGER AS place, CASE i WHEN 0 THEN '{"id": ' || doc_id || ', "said": "} not the end {"}' WHEN 1 THEN '{"list": [1, {"source": "' || source || '"}]}' ELSE '{"cut": [' || n_chars || ', {"open": "' || source || '"}]}' END AS object
FROM documents, unnest([0, 1, 2]) AS u(i) WHERE source IS NOT NULL""")
def answer_objects(t):
    """Several objects of an answer, with braces in strings, between whole texts; the last one is cut off."""
    n, source = F.col("doc_id").cast("string"), F.col("source")
    prose = F.translate(F.coalesce("text", F.lit("")), "{}", "()")
    text = F.concat(
        prose, F.lit(' ```json\n{"id": '), n, F.lit(', "said": "} not the end {"}\n``` it\'s "so: '), F.lit('{"list": [1, {"source": "'), source, F.lit('"}]} and '), F.lit('{"cut": ['), F.col("n_chars").cast("string"), F.lit(', {"open": "'), source,
    )
    rows = t.documents.where("source is not null").select("doc_id", json_blocks.json_objects(text).alias("objects"))
    return rows.select("doc_id", F.posexplode("objects").alias("place", "object"))


@query(r"""WITH rules AS (
    SELECT DISTINCT 10 + p_size % 8 AS rank, p_brand || '/' AS prefix, '/([A-Z]+)/' || (p_size % 8) || '(\d)$' AS pattern, p_size % 8 AS k FROM part UNION ALL SELECT 99, '', '^([^/]+)/', -1 UNION ALL SELECT 5, 'Brand#1', 'Brand#(1\d)/.*/9$', -2
), paths AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size AS path FROM part
), fit AS (SELECT p_partkey, path, r.*, row_number() OVER (PARTITION BY p_partkey ORDER BY rank) AS n FROM paths JOIN rules r ON starts_with(path, prefix) AND regexp_matches(path, pattern))
SELECT p_partkey, path, rank::INTEGER AS rank, CASE k WHEN -1 THEN 'brand' WHEN -2 THEN 'nine' ELSE 'size' END AS kind, CASE k WHEN -1 THEN regexp_extract(path, pattern, 1) WHEN -2 THEN 'of ' || regexp_extract(path, pattern, 1)
    ELSE regexp_extract(path, pattern, 1) || '-' || regexp_extract(path, pattern, 2) END AS title FROM fit WHERE n = 1""")
def ruled_paths(t):
    """Some 200 rules made from the parts, on paths made from them: each path meets the rules of its own prefixes."""
    k = (F.col("p_size") % 8).cast("string")
    says = lambda kind, title: F.create_map(F.lit("kind"), F.lit(kind), F.lit("title"), F.lit(title))
    made = t.part.select((10 + F.col("p_size") % 8).cast("int").alias("rank"), F.concat("p_brand", F.lit("/")).alias("prefix"), F.concat(F.lit("/([A-Z]+)/"), k, F.lit(r"(\d)$")).alias("pattern")).distinct().withColumn("says", says("size", "$1-$2"))
    rule = lambda rank, prefix, pattern, said: F.struct(F.lit(rank).alias("rank"), F.lit(prefix).alias("prefix"), F.lit(pattern).alias("pattern"), said.alias("says"))
    fixed = t.spark.range(1).select(F.inline(F.array(rule(99, "", "^([^/]+)/", says("brand", "$1")), rule(5, "Brand#1", r"Brand#(1\d)/.*/9$", says("nine", "of $1")))))
    paths = t.part.select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("path"))
    out = rules.first_rule(paths, made.unionByName(fixed))
    return out.select("p_partkey", "path", "rank", F.col("said")["kind"].alias("kind"), F.col("said")["title"].alias("title"))


def _systems(t):
    by_type = t.part.groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("sheet_count"), F.min("p_name").alias("description"), F.array_sort(F.collect_set("p_brand")).alias("related"))
    by_brand = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("sheet_count"), F.max("p_size").alias("largest"), F.array_sort(F.collect_set("p_type")).alias("related"))
    again = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.lit(-1).cast("long").alias("sheet_count"), F.max("p_name").alias("description")).where("name < 'Brand#2'")
    return graph.united(by_type, by_brand, again)


_SYSTEMS = """s AS (SELECT p_type AS name, count(*) AS sheet_count, min(p_name) AS description, NULL::INTEGER AS largest, list_sort(list(DISTINCT p_brand)) AS related FROM part GROUP BY 1
UNION ALL SELECT p_brand, count(*), CASE WHEN p_brand < 'Brand#2' THEN max(p_name) END, max(p_size), list_sort(list(DISTINCT p_type)) FROM part GROUP BY 1)"""


@query(f"WITH {_SYSTEMS} SELECT name, sheet_count, description, largest, array_to_string(related, ',') AS related FROM s")
def united_systems(t):
    return _systems(t).withColumn("related", F.array_join("related", ","))


@query(f"WITH {_SYSTEMS}, e AS (SELECT name AS source, unnest(related) AS target, len(related)::INTEGER AS raw_degree FROM s) SELECT e.source, e.target, s.description, s.sheet_count, e.raw_degree FROM e LEFT JOIN s ON s.name = e.target")
def raw_edges(t):
    return graph.edges_with_attributes(_systems(t))


@query("""SELECT 'kv-Shop-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN left('부품 ' || p_name, 60) ELSE p_partkey::VARCHAR END || ' 의 정확한 값과 상수명은? (DataSheet 우선)' AS question,
    CASE WHEN length(p_name || ' ' || p_type) < 25 THEN p_partkey || '|' || p_name || ' ' || p_type ELSE p_partkey::VARCHAR END AS must_contain, 'DataSheet / part' AS hint FROM part""")
def bench_questions(t):
    rows = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("value"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("부품 "), "p_name")).otherwise(F.col("p_name")).alias("comment"))
    return evaluation.key_value_questions(rows, "Shop", "part", "key", "value", ["comment"]).withColumn("must_contain", F.array_join("must_contain", "|"))
