"""Queries over lookups, groupings of hits, merges of results and measures of answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import evaluation
from quarry.documents import grid
from quarry.functions import text as X
from quarry.operators import change, events, joins, ranking, views
from quarry.search import lexical, lookup, retrieval

from .book import query


@query("""SELECT p_type AS term, min(p_name) AS meaning FROM part WHERE contains(lower(p_type), 'econom') GROUP BY 1""")
def glossary_entries(t):
    terms = t.part.groupBy(F.col("p_type").alias("term")).agg(F.min("p_name").alias("meaning"))
    return lookup.glossary(terms, " Econom ")


@query("""WITH c AS (SELECT p_brand AS workbook, p_type AS sheet, p_name AS table_name, p_partkey AS table_id FROM part WHERE contains(lower(p_brand), 'brand#1') AND contains(lower(p_type), 'promo')) SELECT * FROM c""")
def listed_tables(t):
    tables = t.part.select(F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), F.col("p_name").alias("table_name"), F.col("p_partkey").alias("table_id"))
    return lookup.listed(tables, "BRAND#1", "promo")


@query("""SELECT p_name AS name, CASE WHEN p_name LIKE 'small%' THEN 'little ' || split_part(p_name, ' ', 2) ELSE p_name END AS canonical FROM (SELECT DISTINCT p_name FROM part)""")
def canonical_names(t):
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    aliases = names.where("name like 'small%'").select(F.replace(F.initcap("name"), F.lit(" "), F.lit("_-")).alias("alias"), F.concat(F.lit("little "), F.substring_index("name", " ", -1)).alias("canonical"))
    return lookup.canonical_name(names, aliases)


@query("""WITH n AS (SELECT p_brand AS game, p_name AS name, p_type AS category, p_container AS text FROM (SELECT *, repeat('widget ', p_size % 3) AS p_container FROM part)
), s AS (SELECT *, contains(lower(name), 'widget')::INT * 100 + contains(lower(category), 'widget')::INT * 30 + length(text) AS score FROM n WHERE contains(lower(name), 'widget') OR contains(text, 'widget'))
SELECT game, name, score::INTEGER AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY score DESC, name) AS rank FROM s) WHERE rank <= 5""")
def game_nodes(t):
    nodes = t.part.select(F.col("p_brand").alias("game"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.repeat(F.lit("widget "), F.col("p_size") % 3).alias("text"))
    return lookup.node_search(nodes, "Widget")


@query("""SELECT vec_id AS id, label, (vec_id % 100) / 100.0::DOUBLE AS score FROM embeddings WHERE label < 4 UNION ALL SELECT vec_id, label, greatest(0.8, (vec_id % 90) / 90.0::DOUBLE) FROM embeddings WHERE label BETWEEN 4 AND 6""")
def merged_searches(t):
    score = lambda n: (F.col("vec_id") % n / float(n)).alias("score")
    first, again = (t.embeddings.where(w).select(F.col("vec_id").alias("id"), "label", score(n)) for w, n in (("label < 4", 100), ("label between 2 and 6", 90)))
    return lookup.merged_retry(first, again)


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'kind' WHEN p_size < 10 THEN 'size' ELSE 'name' END AS reason FROM part WHERE p_type = 'PROMO' OR p_size < 10 OR contains(p_name, 'bolt')""")
def first_reasons(t):
    return lookup.first_reason([("kind", t.part.where("p_type = 'PROMO'")), ("size", t.part.where("p_size < 10")), ("name", t.part.where("p_name like '%bolt%'"))], "p_partkey")


@query("""SELECT min(p_partkey) AS id FROM part GROUP BY left(replace(lower(p_name || ' of ' || p_type), ' ', ''), 8)""")
def distinct_questions(t):
    questions = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" of ", "p_name", "p_type").alias("query"))
    return lookup.distinct_questions(questions, 8).select("id")


@query("""SELECT page_id, 'see [path] or ' || url AS text, '/home/u/' || page_id || '.txt' AS warnings FROM pages""")
def scrubbed_texts(t):
    said = F.concat(F.lit("see /home/u/"), F.col("page_id").cast("string"), F.lit(".txt or "), F.col("url"))
    out = t.pages.select("page_id", lookup.without_internal_paths(said).alias("o"))
    return out.select("page_id", "o.text", F.array_join("o.warnings", ",").alias("warnings"))


@query("""WITH h AS (SELECT DISTINCT p_brand || '/' || p_type AS parent, p_name AS item FROM part WHERE p_size = 7), c AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n FROM h)
SELECT CASE WHEN n >= 2 THEN parent ELSE item END AS "group", string_agg(item, ',' ORDER BY item) AS items, count(*) AS size FROM c GROUP BY 1""")
def grouped_hits(t):
    hits = t.part.where("p_size = 7").select(F.concat_ws("/", "p_brand", "p_type").alias("parent"), F.col("p_name").alias("item")).distinct()
    return lexical.grouped_hits(hits, "parent", "item").withColumn("items", F.array_join("items", ","))


@query("""WITH r AS (SELECT p_partkey AS doc_id, p_size / 50.0::DOUBLE AS score, 'L1' AS source FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, 0.5, 'vector' FROM part WHERE p_type = 'PROMO')
SELECT doc_id, max(score) AS score, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source FROM r GROUP BY 1""")
def merged_strategies(t):
    one = t.part.where("p_size > 20").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("score"), F.lit("L1").alias("source"))
    two = t.part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("doc_id"), F.lit(0.5).alias("score"), F.lit("vector").alias("source"))
    return lexical.merged(one, two)


@query("""WITH d AS (SELECT p_partkey AS doc_id, p_brand, p_type, p_brand || '/' || p_name AS path, CASE WHEN p_size % 2 = 0 THEN repeat('s', p_size) END AS summary FROM part)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY length(path) DESC, length(coalesce(summary, '')) DESC, doc_id) AS n FROM d) WHERE n = 1""")
def deduplicated_docs(t):
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), "p_brand", "p_type", F.concat_ws("/", "p_brand", "p_name").alias("path"), F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("s"), F.col("p_size"))).alias("summary"))
    return lexical.distinct_docs(docs, ["p_brand", "p_type"]).select("doc_id")


@query("""SELECT max(p_size / 50.0)::DOUBLE AS best, count(*) FILTER (p_type = 'PROMO') AS titles, count(*) FILTER (p_size / 50.0 >= 0.85) AS strong, max(p_size / 50.0) >= 0.95 AND count(*) FILTER (p_type = 'PROMO') > 0 AND count(*) FILTER (p_size / 50.0 >= 0.85) >= 3 AS stop FROM part""")
def search_confidence(t):
    hits = t.part.select((F.col("p_size") / 50.0).alias("score"), F.when(F.col("p_type") == "PROMO", "title_prefix").otherwise("body").alias("via"))
    return lexical.confidence(hits)


@query("""WITH s AS (SELECT o_orderkey, [1 + o_orderkey % 5, 2 + o_orderkey % 4, 5]::DOUBLE[] AS s, o_orderkey % 3 = 0 AS src, (o_orderkey % 11) / 10.0 AS k FROM orders)
SELECT o_orderkey, CASE WHEN list_sum(s) / 3 >= 4 AND list_min(s) >= 3 THEN 'PASS' WHEN list_sum(s) / 3 >= 3 AND list_min(s) >= 2 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict, k >= 0.8 OR (k >= 0.5 AND src) AS passes,
    CASE WHEN NOT src THEN 'none' WHEN o_orderkey % 7 = 0 THEN 'low' WHEN o_orderkey % 4 >= 2 THEN 'high' WHEN o_orderkey % 4 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def answer_verdicts(t):
    n = F.col("o_orderkey")
    scores = F.array((n % 5 + 1).cast("double"), (n % 4 + 2).cast("double"), F.lit(5.0))
    found = n % 3 == 0
    return t.orders.select(
        "o_orderkey", evaluation.verdict(scores).alias("verdict"), evaluation.answer_passes(n % 11 / 10.0, found).alias("passes"), evaluation.answer_confidence(found, (n % 7 == 0).cast("int"), (n % 4).cast("int")).alias("confidence")
    )


@query("""SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS holds FROM documents""")
def contained_parts(t):
    return t.documents.select("doc_id", evaluation.must_contain(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("holds"))


@query("""SELECT a.label, a.n AS n_1, b.n AS n_2, c.n AS n_3 FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) a JOIN (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 AND label > 1 GROUP BY 1) b USING (label) JOIN (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1) c USING (label)""")
def three_runs(t):
    run = lambda where: t.embeddings.where(where).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.in_all_runs([run("true"), run("vec_id % 2 = 0 and label > 1"), run("vec_id % 3 = 0")], "label", "n")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'own ' || c_custkey END, 'nation ' || n_name) AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey > 5""")
def first_matches(t):
    own = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("own "), F.col("c_custkey").cast("string")).alias("label"))
    nation = t.nation.where("n_nationkey > 5").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("nation "), "n_name").alias("label"))
    return joins.first_match(t.customer.select("c_custkey", "c_nationkey"), [(own, ["c_custkey"]), (nation, ["c_nationkey"])], "label").select("c_custkey", "label")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 36 HOUR""")
def recent_events(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.after_cutoff(rows, "ts", F.expr("TIMESTAMP '2024-01-15 00:00:00'"), "36h").select("event_id")


@query("""WITH n AS (SELECT DISTINCT left(p_name, 8) AS name FROM part), d AS (SELECT DISTINCT p_name AS title FROM part) SELECT name, title FROM n JOIN d ON starts_with(title, name) AND length(title) > length(name)""")
def cut_names(t):
    names = t.part.select(F.left("p_name", F.lit(8)).alias("name")).distinct()
    return change.orphans(names, t.part.select(F.col("p_name").alias("title")).distinct(), "name", "title", prefix=5)


@query("""WITH c AS (SELECT p_brand AS workbook, p_type AS sheet, p_name AS section_path, CASE WHEN p_size % 2 = 0 THEN '| a |' || chr(10) || '| --- |' ELSE '```mermaid' END AS text FROM part)
SELECT workbook, array_to_string(list_sort(list(DISTINCT sheet)), ',') AS sheets, count(*) AS chunks, count(*) FILTER (text LIKE '|%') AS tables, count(*) FILTER (text LIKE '`%') AS charts, sum(length(text))::BIGINT AS size,
    array_to_string(list_sort(list(DISTINCT section_path))[1:5], ',') AS sections FROM c GROUP BY 1""")
def workbook_features(t):
    text = F.when(F.col("p_size") % 2 == 0, "| a |\n| --- |").otherwise("```mermaid")
    out = views.system_features(t.part.select(F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), F.col("p_name").alias("section_path"), text.alias("text")), 5)
    return out.withColumns({"sheets": F.array_join("sheets", ","), "sections": F.array_join("sections", ",")})


@query("""SELECT o_orderpriority AS severity, count(*) AS conflicts FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY 1""")
def conflict_severities(t):
    return views.severity_counts(t.orders.select(F.col("o_custkey").alias("pair_id"), F.col("o_orderstatus").alias("topic"), F.col("o_orderpriority").alias("severity")))


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS n FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM q WHERE n = 1""")
def dearest_lines(t):
    out = ranking.best_of(t.lineitem, ["l_suppkey"], F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT n_nationkey, '{"id":"' || n_nationkey || '","name":"' || n_name || '","region":"r' || n_regionkey || '"}' AS merged FROM nation""")
def merged_objects(t):
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    left, right = F.to_json(F.struct(k.alias("id"), F.lit("old").alias("name"))), F.to_json(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("r"), r).alias("region")))
    merged = F.from_json(X.merged_json(left, right), "id string, name string, region string")
    return t.nation.select("n_nationkey", F.to_json(merged).alias("merged"))


_GRID = """g AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row, p_name, p_type, p_size FROM part
), cells AS (SELECT sheet, row, 1 AS col, p_name AS value, p_size FROM g UNION ALL SELECT sheet, row, 2, p_type, p_size FROM g UNION ALL SELECT sheet, row, 3, '', p_size FROM g UNION ALL SELECT sheet, row, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 6 END, 's' || p_size, p_size FROM g)"""


def _grid(t):
    row = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    g = t.part.select(F.col("p_brand").alias("sheet"), row.alias("row"), "p_name", "p_type", "p_size")
    cell = lambda col, value: F.struct(col.alias("col"), value.alias("value"))
    last = cell(F.when(F.col("p_size") % 2 == 0, 4).otherwise(6), F.concat(F.lit("s"), F.col("p_size").cast("string")))
    cells = g.select("sheet", "row", F.inline(F.array(cell(F.lit(1), F.col("p_name")), cell(F.lit(2), F.col("p_type")), cell(F.lit(3), F.lit("")), last)))
    merges = g.where("p_size % 2 = 0").select("sheet", F.col("row").alias("min_row"), F.lit(2).alias("min_col"), F.col("row").alias("max_row"), F.lit(3).alias("max_col"))
    return cells, merges


@query(f"""WITH {_GRID} SELECT a.sheet, a.row::INTEGER AS row, a.col, CASE WHEN a.col = 3 AND a.p_size % 2 = 0 THEN b.value ELSE a.value END AS value FROM cells a JOIN cells b ON b.sheet = a.sheet AND b.row = a.row AND b.col = 2""")
def merged_cells(t):
    """Values of merged ranges in all of their places."""
    return grid.filled(*_grid(t))


@query(f"""WITH {_GRID} SELECT DISTINCT sheet, row::INTEGER AS row, 1 AS first, 4 AS last, 4::BIGINT AS size FROM cells WHERE p_size % 2 = 0""")
def header_runs(t):
    """Runs of neighbouring filled cells of three or more, once merged cells are filled."""
    return grid.clusters(grid.filled(*_grid(t))).select("sheet", "row", "first", "last", "size")


_CHUNKS = """c AS (SELECT p_partkey::VARCHAR AS id, p_brand AS workbook, p_type AS sheet, p_name AS section_path, p_name || ' ' || p_size AS text, (p_size * 10)::BIGINT AS tokens FROM part)"""


def _chunks(t):
    return t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), F.col("p_name").alias("section_path"), F.concat_ws(" ", "p_name", "p_size").alias("text"), (F.col("p_size") * 10).cast("bigint").alias("tokens"))


@query(f"""WITH {_CHUNKS}, s AS (SELECT *, 0.6 + 0.3 * (contains(lower(text), 'cold')::INT + contains(lower(text), 'bolt')::INT) / 2.0 + CASE WHEN contains(lower(section_path), 'cold') OR contains(lower(section_path), 'bolt') THEN 0.2 ELSE 0 END AS score FROM c WHERE workbook IN ('Brand#11', 'Brand#12', 'Brand#13'))
SELECT id, round(round_even(score, 9)::DOUBLE * 0.5, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY round_even(score, 9) DESC, id) AS n FROM s) WHERE n <= 3""")
def graph_neighbours(t):
    """The best chunks of a system's neighbours, at half their score."""
    edges = t.spark.range(3).select(F.lit("Brand#1").alias("src"), F.concat(F.lit("Brand#1"), (F.col("id") + 1).cast("string")).alias("dst"))
    out = retrieval.graph_layer(_chunks(t), edges, ["Brand#1"], "cold bolt")
    return out.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_CHUNKS}, h AS (SELECT workbook, sheet, max(tokens)::DOUBLE AS score FROM c WHERE tokens > 480 GROUP BY ALL), z AS (SELECT c.workbook, c.sheet, score, sum(tokens) AS size FROM c JOIN h USING (workbook, sheet) GROUP BY c.workbook, c.sheet, score
), u AS (SELECT *, sum(size) OVER (ORDER BY score DESC, workbook, sheet) AS upto FROM z), l AS (SELECT workbook, sheet, 6000 - upto + size AS room FROM u WHERE (size <= 6000 - upto + size OR 6000 - upto + size >= 500) AND 6000 - upto + size > 0)
SELECT id FROM (SELECT c.id, room, sum(tokens) OVER (PARTITION BY c.workbook, c.sheet ORDER BY c.id) AS upto FROM c JOIN l USING (workbook, sheet)) WHERE upto <= room""")
def whole_sheets(t):
    """All chunks of the best hits' sheets within a budget of tokens."""
    hits = _chunks(t).where("tokens > 480").withColumn("score", F.col("tokens").cast("double"))
    return retrieval.whole_sheets(_chunks(t), hits, budget=6000).select("id")


@query("""WITH a(alias, target, weight) AS (SELECT DISTINCT lower(p_name), p_name, 1.0 FROM part), q AS (SELECT page_id, (SELECT min(lower(p_name)) FROM part WHERE p_partkey = page_id) AS one, (SELECT min(lower(p_name)) FROM part WHERE p_partkey = page_id + 1) AS two FROM pages)
SELECT page_id AS query_id, a.target, a.alias FROM q JOIN a ON a.alias = one OR a.alias = two""")
def alias_places(t):
    """Names in questions, longest first, none over places already taken."""
    names = t.part.select("p_partkey", F.lower("p_name").alias("n"))
    one, two = (names.select((F.col("p_partkey") - k).alias("query_id"), F.col("n").alias(f"n{k}")) for k in (0, 1))
    asked = t.pages.select(F.col("page_id").alias("query_id")).join(one, "query_id").join(two, "query_id").select("query_id", F.concat_ws(" or ", F.lit("is it"), "n0", "n1").alias("query"))
    aliases = t.part.select(F.lower("p_name").alias("alias"), F.col("p_name").alias("target"), F.lit(1.0).alias("weight")).distinct()
    return retrieval.alias_hits(asked, aliases)
