"""Queries over search plans and stored postings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.lineage import cut, shared_dir
from quarry.operators import graph
from quarry.search import executor, postings, tools

from .book import query


def plan_tables(t):
    """Plans for all orders over the parts as chunks: (queries, steps, chunks, aliases, edges, answers)."""
    part = t.part
    text = F.concat_ws(" ", "p_name", "p_type", "p_size")
    chunks = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("workbook"), F.concat(F.lit("Sheet: "), "p_type").alias("sheet"), F.col("p_name").alias("section_path"), text.alias("text"))
    form = lambda c: part.select(F.lower(c).alias("alias"), F.col("p_brand").alias("workbook")).distinct()
    aliases = form(F.col("p_brand")).unionByName(form(F.concat(F.lit("Kind "), "p_type"))).unionByName(form(F.concat(F.lit("PK_"), F.col("p_size").cast("string"))))
    aliases = cut(aliases.withColumn("rank", F.row_number().over(W.partitionBy("alias").orderBy("workbook"))), "aliases")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("dst"))
    edges = cut(graph.symmetric(part.where("p_partkey % 7 = 0").join(following.hint("merge"), "p_partkey").select(F.col("p_brand").alias("src"), "dst")), "edges")
    said = F.concat_ws(" of ", "p_name", "p_brand")
    systems = F.array(
        F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 30).cast("string")), (F.col("o_orderkey") % 60).cast("string"),
        F.when(F.col("o_orderkey") % 4 == 1, "CONOM").when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("kind "), "p_type")).when(F.col("o_orderkey") % 4 == 3, "nothing here"), F.lit("PROMO"),
    )
    queries = t.orders.join(part.hint("merge"), t.orders["o_custkey"] == part["p_partkey"]).select(
        F.col("o_orderkey").alias("query_id"), said.alias("query"), F.when(F.col("o_orderstatus") == "F", "overview").otherwise("fact").alias("query_type"), systems.alias("key_systems")
    )
    kind, none = F.col("l_partkey") % 5, F.lit(None).cast("string")
    when = lambda k, c: F.when(kind == k, c)
    args = F.struct(when(0, said).when(kind == 2, F.col("p_name")).alias("query"), when(1, F.col("p_brand")).alias("workbook"), when(2, F.col("p_brand")).alias("section"), when(3, F.col("p_brand")).otherwise(none).alias("system"), when(4, F.col("p_type")).alias("table"))
    tool = F.element_at(F.array(*map(F.lit, ("retrieve", "section_search", "section_search", "kg_related", "query_game_data"))), (kind + 1).cast("int"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    lines = t.lineitem.withColumn("step", place).join(part.hint("merge"), F.col("l_partkey") == part["p_partkey"])
    lines = cut(lines.select(F.col("l_orderkey").alias("query_id"), "step", tool.alias("tool"), args.alias("args"), "l_quantity"), "lines")
    steps = lines.select("query_id", "step", "tool", "args")
    answers = lines.where("l_quantity > 10").select("query_id", "step")
    return queries, steps, chunks, aliases, edges, answers


_SCORE = """least(1.5, 0.6 + 0.3 * len(list_filter(terms, lambda x: contains(lower(text), x))) / greatest(len(terms), 1) + CASE WHEN len(list_filter(terms, lambda x: contains(lower(section_path), x))) > 0 THEN 0.2 ELSE 0.0 END
        + least(0.3, 0.2 * n) + CASE WHEN n > 0 AND n >= greatest(1.0, len(string_split(own, ' ')) * 0.5) THEN 0.3 ELSE 0.0 END)"""


@query(f"""WITH chunks AS (SELECT p_partkey::VARCHAR AS id, p_brand AS workbook, lower(p_type) AS own, p_name AS section_path, concat_ws(' ', p_name, p_type, p_size) AS text FROM part
), forms AS (SELECT DISTINCT unnest([lower(p_brand), 'kind ' || lower(p_type), 'pk_' || p_size]) AS alias, p_brand AS workbook FROM part
), aliases AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY workbook) AS rank FROM forms
), pairs AS (SELECT a.p_brand AS src, b.p_brand AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 7 = 0 AND a.p_brand <> b.p_brand
), edges AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs
), queries AS (
    SELECT o_orderkey AS query_id, p_name || ' of ' || p_brand AS query, p_brand AS own, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 8 END AS cap,
        ['Brand#' || (o_orderkey % 30), (o_orderkey % 60)::VARCHAR, CASE o_orderkey % 4 WHEN 1 THEN 'CONOM' WHEN 2 THEN 'kind ' || p_type WHEN 3 THEN 'nothing here' END] AS systems FROM orders JOIN part ON p_partkey = o_custkey
), steps AS (
    SELECT l_orderkey AS query_id, step, l_partkey % 5 AS kind, l_quantity, p_name, p_brand, p_type, p_name || ' of ' || p_brand AS said, q.query
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS step FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN queries q ON q.query_id = l_orderkey
), asks AS (
    SELECT query_id, own AS workbook, query, 0::BIGINT AS turn, 'first' AS label, 15 AS most, 'structural' AS source, 0 AS does FROM queries
    UNION ALL SELECT query_id, p_brand, said, (step + 1) * 256, 'step ' || step, 10, 'structural', 0 FROM steps WHERE kind = 0 AND said <> query
    UNION ALL SELECT query_id, p_brand, CASE kind WHEN 1 THEN query ELSE p_name END, (step + 1) * 256, 'step ' || step, 10, 'section_search', 1 FROM steps WHERE kind IN (1, 2)
    UNION ALL SELECT query_id, dst, query, (step + 1) * 256 + n, 'step ' || step, 3, 'kg_agent', 0 FROM steps JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM edges) ON src = coalesce((SELECT min(src) FROM edges WHERE src = p_brand), (SELECT min(src) FROM edges WHERE contains(src, p_brand) OR contains(p_brand, src))) WHERE kind = 3 AND n <= 3
    UNION ALL SELECT query_id, workbook, query, 1099511627776 + nth * 8 + rank, 'system ' || nth, 10, 'agent_planned', 2 FROM (
        SELECT query_id, query, nth, coalesce((SELECT alias FROM (SELECT DISTINCT alias FROM aliases) WHERE alias = name), (SELECT alias FROM (SELECT DISTINCT alias FROM aliases) WHERE alias = 'pk_' || name), (SELECT min(alias) FROM aliases WHERE contains(alias, name))) AS alias
        FROM (SELECT query_id, query, i - 1 AS nth, lower(systems[i]) AS name FROM queries, unnest([1, 2, 3]) AS u(i)) WHERE name IS NOT NULL) JOIN aliases USING (alias) WHERE rank <= 2
), asked AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS terms FROM (SELECT DISTINCT workbook, query FROM asks)
), scored AS (SELECT a.workbook, query, id, round_even({_SCORE}, 9) AS score FROM (SELECT a.*, c.id, c.own, c.section_path, c.text, len(list_filter(terms, lambda x: length(x) >= 2 AND contains(c.own, x))) AS n FROM asked a JOIN chunks c USING (workbook)) a
), placed AS (SELECT *, row_number() OVER (PARTITION BY workbook, query ORDER BY score DESC, id) AS place FROM scored
), events AS (
    SELECT query_id, id, workbook, turn, place, label, source, does, CASE source WHEN 'kg_agent' THEN score * 0.7 WHEN 'structural' THEN score ELSE greatest(score, 1.2) END AS score FROM asks JOIN placed USING (workbook, query) WHERE place <= most
    UNION ALL SELECT query_id, 'gamedata_' || step, 'GameData/' || p_type, (step + 1) * 256, 1, 'step ' || step, 'game_data_query', 0, 1.5 FROM steps WHERE kind = 4 AND l_quantity > 10
), chunk AS (
    SELECT query_id, id, min(workbook) AS workbook, min(turn) AS turn, min_by(place, turn) AS place, string_agg(label, ', ' ORDER BY turn, place) AS found_by,
        list_reduce(list({{'score': score::DOUBLE, 'source': source, 'does': does}} ORDER BY turn, place), lambda a, e: {{
            'score': CASE e.does WHEN 1 THEN greatest(a.score, e.score) WHEN 2 THEN a.score + 0.3 ELSE a.score END, 'source': CASE e.does WHEN 2 THEN a.source || '+' || e.source ELSE a.source END, 'does': 0}}) AS fold
    FROM events GROUP BY query_id, id
), capped AS (
    SELECT c.query_id, id, workbook, round_even(fold.score, 9) AS score, fold.source AS source, found_by, turn, place, row_number() OVER (PARTITION BY c.query_id, workbook ORDER BY round_even(fold.score, 9) DESC, turn, place, id) > cap AS over
    FROM chunk c JOIN queries q USING (query_id)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY over, score DESC, turn, place, id)::INTEGER AS rank, id, workbook, round(score, 6) AS score, source, found_by FROM capped QUALIFY rank <= 200""")
def plan_results(t):
    """All orders' search plans in one job."""
    queries, steps, chunks, aliases, edges, answers = plan_tables(t)
    found = executor.run_plans(queries, steps, chunks, aliases, edges, executor.by_aliases(chunks, aliases), answers)
    return found.withColumn("score", F.round("score", 6))


def _stored_postings(t) -> str:
    path = f"{shared_dir(t.spark)}/quarry/postings-{uuid.uuid4().hex}"
    postings.write(postings.term_counts(t.documents), path, buckets=16, tasks_a_bucket=postings.shares(t.documents))
    return path


_COUNTS = r"SELECT word, doc_id, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY 1, 2"


@query(f"""WITH c AS ({_COUNTS}), t AS (SELECT word, count(*) AS docs, min(doc_id) AS first, max(doc_id) AS last, max(c)::INTEGER AS most FROM c GROUP BY 1)
SELECT word AS term, docs, first, last, most, row_number() OVER (ORDER BY docs DESC, word) AS rank FROM t""")
def term_files(t):
    """The terms of stored posting lists of all documents, by frequency."""
    return postings.by_frequency(t.spark, _stored_postings(t)).select("term", "docs", "first", "last", "most", "rank")


@query(f"""WITH c AS ({_COUNTS}) SELECT doc_id AS id, sum(c)::BIGINT AS count FROM c WHERE word IN ('license', 'the') GROUP BY 1 HAVING count(*) = 2""")
def two_terms_together(t):
    """Documents with both a frequent and a rare term, read from stored posting lists by their buckets."""
    return postings.holding_all(t.spark, _stored_postings(t), ["license", "The"], buckets=16)


@query("""WITH d AS (SELECT doc_id AS id, text FROM documents), p AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part),
a AS (SELECT 'find_text' AS tool, id, ((length(lower(text)) - length(replace(lower(text), 'ation', ''))) / 5)::DOUBLE AS score FROM d WHERE contains(lower(text), 'ation') ORDER BY score DESC, id LIMIT 20
), b AS (SELECT 'find_phrases' AS tool, id, round_even((least(1.0, 0.7 + 0.15 * (contains(text, 'cold widget')::INT + contains(text, 'PROMO')::INT + contains(text, 'bolt')::INT) / 3 + CASE WHEN contains(text, 'cold widget') THEN 0.15 ELSE 0 END))::DOUBLE, 9) AS score
    FROM p WHERE contains(text, 'cold widget') OR contains(text, 'PROMO') OR contains(text, 'bolt') ORDER BY score DESC, id LIMIT 30
), c AS (SELECT 'find_terms' AS tool, id, (list_contains(string_split(lower(text), ' '), 'widget')::INT + list_contains(string_split(lower(text), ' '), 'small')::INT)::DOUBLE / 2 AS score FROM p WHERE score >= 0.75 ORDER BY score DESC, id LIMIT 500
), e AS (SELECT 'find_vectors' AS tool, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)::DOUBLE)), 6) AS score FROM embeddings
    ORDER BY score DESC, id LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e""")
def called_tools(t):
    """Four tools called by name, in SQL, with named arguments."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    parts = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    asked = [
        (docs, "find_text", {"keyword": "Ation", "case": "any", "limit": 20}), (parts, "find_phrases", {"phrases": ["cold widget", "PROMO", "bolt"], "limit": 30}),
        (parts, "find_terms", {"query": "small widget", "least": 0.75, "limit": 500}), (vectors, "find_vectors", {"vector": [1.0, -0.5] * 32}),
    ]
    out = [tools.call(rows, name, arguments).select(F.lit(name).alias("tool"), "id", "score") for rows, name, arguments in asked]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
