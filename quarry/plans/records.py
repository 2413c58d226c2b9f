"""Queries over conversations, summaries, stored vectors, trees and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import spec
from quarry.documents import trees
from quarry.functions import text as X
from quarry.operators import conversations
from quarry.search import store, summaries

from .book import query


@query("""SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, last + row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, text FROM (SELECT c.*, m.last FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) m USING (conv_id)) WHERE role = 'user'
UNION ALL SELECT conv_id + 1000000000, turn, role, text FROM conversations WHERE turn = 0""")
def appended_turns(t):
    said = t.conversations.where("role = 'user'").withColumn("at", F.col("turn"))
    begun = t.conversations.where("turn = 0").withColumns({"conv_id": F.col("conv_id") + 1000000000, "at": F.col("turn")})
    return conversations.appended(t.conversations, said.unionByName(begun), "at").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")


@query("""SELECT conv_id, CASE WHEN length(f) > 40 THEN left(f, 40) || '...' ELSE f END AS title, n AS turn_count, last AS last_turn FROM (SELECT conv_id, min_by(text, turn) AS f, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1)""")
def conversation_list(t):
    return conversations.summarised(t.conversations)


@query("""WITH c AS (SELECT conv_id, 'Conversation ' || conv_id AS title, count(*) AS turns, TIMESTAMP '2020-01-01' AS created_at FROM conversations GROUP BY 1)
SELECT * FROM c UNION ALL SELECT conv_id + 1000000000, '(fork) ' || title, turns, TIMESTAMP '2024-01-01' FROM c""")
def forked_conversations(t):
    known = t.conversations.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.expr("TIMESTAMP '2020-01-01'").alias("created_at"))
    known = known.withColumn("updated_at", F.col("created_at"))
    wanted = known.select("conv_id", (F.col("conv_id") + 1000000000).alias("new_id"))
    heads, turns = conversations.forked(known, t.conversations, wanted, F.expr("TIMESTAMP '2024-01-01'"))
    return heads.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conv_id").select("conv_id", "title", "turns", "created_at")


@query("""SELECT 'xlsx::' || p_brand || '::' || p_partkey AS doc_id, '7_' || p_type || ' / ' || p_brand || ' / ' || p_partkey AS path, p_name AS summary, p_type AS term, p_brand AS source FROM part
UNION ALL SELECT 'conf::' || p_type || '/' || p_brand || '/' || p_partkey, p_type || ' / ' || p_brand || ' / ' || p_partkey, p_name, NULL, '' FROM part""")
def parsed_summaries(t):
    key = F.col("p_partkey").cast("string")
    book = F.concat(F.lit("# T\n> 출처: "), F.col("p_brand"), F.lit(" \n\n## 한 줄 설명\n"), F.col("p_name"), F.lit("\n\n## 핵심 용어\n- "), F.col("p_type"), F.lit("\n-\n\nrest\n- no\n"))
    page = F.concat(F.lit("# T\n\n> said\n  "), F.col("p_name"), F.lit("  \nrest"))
    files = t.part.select(F.concat(F.lit("xlsx/7_"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/"), key, F.lit(".md")).alias("path"), book.alias("text")).unionByName(
        t.part.select(F.concat(F.lit("confluence/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/"), key, F.lit(".md")).alias("path"), page.alias("text")))
    return summaries.summaries(files).select("doc_id", "path", "summary", F.get("key_terms", F.lit(0)).alias("term"), "source")


@query("""SELECT p_partkey, p_name AS workbook, p_brand AS sheet, p_type AS section FROM part UNION ALL SELECT p_partkey, p_type, p_brand, NULL FROM part""")
def named_sources(t):
    said = F.concat(F.lit("As [출처 1: "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" / "), F.col("p_type"), F.lit("] and [출처: "), F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.lit("] say"))
    return t.part.select("p_partkey", F.explode(X.named_sources(said)).alias("s")).select("p_partkey", "s.*")


@query("""SELECT regexp_replace('docs__' || coalesce(source, '') || '____' || vec_id, '[^a-zA-Z0-9_]', '_', 'g') AS id, text AS document, 'content' AS chunk_type, len(embedding) AS dims FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""")
def stored_vectors(t):
    chunks = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("vec_id", "text", F.col("embedding").alias("vector"), F.lit("docs").alias("workbook"), F.col("source").alias("sheet"), F.lit("").alias("section_path"))
    return store.entries(chunks, "vec_id").select("id", "document", "facts.chunk_type", F.size("vector").cast("bigint").alias("dims"))


@query("""WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS title FROM nation)
SELECT r AS tree, 'r' || r AS id, NULL AS parent, r_name AS title, 'folder' AS kind, 0 AS version, r_name AS path FROM (SELECT r_regionkey AS r, r_name FROM region)
UNION ALL SELECT r, 'n' || k, 'r' || r, title, 'page', k, r_name || '/' || title FROM n JOIN region ON r = r_regionkey
UNION ALL SELECT n.r, 's' || s_suppkey, 'n' || k, s_name, 'page', 0, r_name || '/' || title || '/' || s_name FROM n JOIN region ON r = r_regionkey JOIN supplier ON s_nationkey = k""")
def manifest_nodes(t):
    low = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"))).alias("children"))
    mid = t.nation.join(low, F.col("k") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").alias("r")).agg(
        F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("version"), "children")).alias("children"))
    top = t.region.join(mid, F.col("r") == F.col("r_regionkey"), "left")
    made = top.select(F.col("r_regionkey").alias("tree"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("title"), F.lit("folder").alias("type"), "children")).alias("manifest"))
    return trees.nodes(made).select("tree", "id", "parent", "title", "kind", F.col("version").cast("int").alias("version"), "path")


@query("SELECT p_partkey, left(p_name, 4) || CASE WHEN length(p_name) > 4 THEN chr(10) ELSE '' END || chr(10) || '> ' || p_type || chr(10) || substr(p_name, 5) AS text FROM part")
def inserted_text(t):
    return t.part.select("p_partkey", trees.with_piece(F.col("p_name"), F.lit(4), F.col("p_type")).alias("text"))


@query("""SELECT p_brand || '.xlsx' AS file_path, count(*) AS sheets, sum(p_size)::BIGINT AS total_size, 1 AS version FROM part WHERE p_brand NOT LIKE '\\_%' ESCAPE '\\' GROUP BY 1""")
def backfilled_conversions(t):
    files = t.part.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), F.lit("content.md")).alias("path"), F.col("p_size").alias("size"))
    other = t.part.select(F.concat_ws("/", F.concat(F.lit("_"), F.col("p_brand")), F.lit("content.md")).alias("path"), F.col("p_size").alias("size"))
    return trees.backfilled(files.unionByName(other))[1].select("file_path", "sheets", "total_size", "version")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND (contains(lower(source), 'a') OR contains(lower(text), 'the'))")
def searched_documents(t):
    kept = t.documents.where(spec.any_of({"lang": F.col("lang"), "source": F.col("source")}, {"lang": "en, de", "source": None}))
    return kept.where(spec.found_in("A", "source") | spec.found_in("The", "text")).select("doc_id", "lang", "source")


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE turn > 0) AS up, count(*) FILTER (WHERE turn = 0) AS down FROM conversations GROUP BY 1")
def answer_votes(t):
    return conversations.votes(t.conversations.withColumn("vote", F.when(F.col("turn") > 0, 1).otherwise(-1)), "role")
