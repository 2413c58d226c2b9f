"""Queries over documents, pages, passages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import catalog
from quarry.documents import cleanup, grid, markdown
from quarry.functions import text as X
from quarry.functions import udfs
from quarry.operators import passages, ranking
from quarry.search import lexical, retrieval

from .book import query


@query("SELECT doc_id, CAST(greatest(1, floor(length(text) * 0.5)) AS INTEGER) AS tokens, substr(sha256(text), 1, 16) AS hash FROM documents")
def tokens_and_hash(t):
    return t.documents.select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"), catalog.content_hash(F.col("text")).alias("hash"))


@query("""SELECT source, count(*) AS chunks, sum(tk)::BIGINT AS tokens, min(tk) AS low, max(tk) AS high, count(*) FILTER (WHERE tk < 200) AS small, count(*) FILTER (WHERE tk BETWEEN 200 AND 2000) AS middle, count(*) FILTER (WHERE tk > 2000) AS large, count(*) FILTER (WHERE contains(text, '|')) AS with_bar
FROM (SELECT *, CAST(greatest(1, floor(length(text) * 0.5)) AS INTEGER) AS tk FROM documents) GROUP BY 1""")
def chunk_statistics(t):
    rows = t.documents.withColumn("tk", X.estimated_tokens(F.col("text")))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tk").alias("tokens"), F.min("tk").alias("low"), F.max("tk").alias("high"), F.count_if(F.col("tk") < 200).alias("small"),
        F.count_if(F.col("tk").between(200, 2000)).alias("middle"), F.count_if(F.col("tk") > 2000).alias("large"), F.count_if(F.contains("text", F.lit("|"))).alias("with_bar"),
    )


@query(r"SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY 1")
def term_index(t):
    return t.documents.select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


@query(r"""SELECT name, count(*) AS docs FROM (SELECT DISTINCT url, unnest(list_concat(list_concat(
        regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9]+(?:_[A-Z][a-zA-Z0-9]+)+\b'), regexp_extract_all(text, '\b[A-Z][a-z]{1,}(?:[A-Z][a-z0-9]+){1,}\b')), regexp_extract_all(text, '\b[A-Z]{3,}(?:_[A-Z0-9]{2,})+\b'))) AS name
    FROM (SELECT p_partkey AS url, concat('Meta_', replace(p_type, ' ', '_Kind'), ' of Size', p_size, 'Class and ', upper(substr(p_type, 1, 3)), '_', p_size + 10, '_X1 or plain_name') AS text FROM part)) WHERE length(name) >= 4 GROUP BY 1""")
def identifiers(t):
    kind = F.replace("p_type", F.lit(" "), F.lit("_Kind"))
    said = F.concat(F.lit("Meta_"), kind, F.lit(" of Size"), F.col("p_size").cast("string"), F.lit("Class and "), F.upper(F.substring("p_type", 1, 3)), F.lit("_"), (F.col("p_size") + 10).cast("string"), F.lit("_X1 or plain_name"))
    return t.part.select(F.explode(X.identifiers(said)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS hits FROM documents WHERE contains(text, 'the')")
def substring_counts(t):
    return t.documents.withColumn("hits", X.count_of(F.col("text"), F.lit("the"))).where("hits > 0").select("doc_id", "hits")


@query("SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'ation') - 60), instr(lower(text), 'ation') - greatest(1, instr(lower(text), 'ation') - 60) + 65) AS snippet FROM documents WHERE instr(lower(text), 'ation') > 0")
def snippets(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.lit("ation")).alias("snippet")).where("snippet is not null")


@query("SELECT p_partkey, regexp_replace(p_name || '_' || p_brand || '_' || p_type, '[^a-zA-Z0-9_]', '_', 'g') AS chunk_id FROM part")
def chunk_ids(t):
    return t.part.select("p_partkey", X.chunk_id(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("chunk_id"))


@query("SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS text FROM pages")
def page_text(t):
    return t.pages.select("page_id", X.without_tags(F.col("html")).alias("text"))


@query()
def page_markdown(t):
    return t.pages.select("page_id", udfs.html_to_markdown("html").alias("markdown"))


_BODY = r"d AS (SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS text FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_BODY} SELECT doc_id, 0 AS position, '' AS heading, text FROM d WHERE text <> ''")
def document_sections(t):
    return markdown.sections(t.documents)


@query(rf"""WITH {_BODY} SELECT doc_id, 0 AS chunk, '' AS heading, greatest(1, floor(length(text) * 0.5))::INTEGER AS tokens, regexp_matches(text, '\|.*\|.*\|') AS has_table, contains(text, '```mermaid') AS has_mermaid,
    regexp_matches(text, '!\[[^\]]*\]\(') AS has_images FROM d WHERE text <> ''""")
def document_chunks(t):
    return markdown.chunks(t.documents).select("doc_id", "chunk", "heading", "tokens", "has_table", "has_mermaid", "has_images")


@query()
def document_cleanup(t):
    sections = cleanup.section_frame(t.documents.withColumn("text", cleanup.without_marks(F.col("text"), continued=False)))
    for step in (cleanup.continued, cleanup.without_repeated_headings, cleanup.without_repeats, cleanup.without_cross_level_repeats, cleanup.without_twin_neighbours, cleanup.without_lone_headings):
        sections = step(sections)
    return cleanup.rendered(sections)


def _sheets(t):
    """Small Markdown documents with headings and a table row, made from the parts."""
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("## Part "), F.col("p_partkey").cast("string"), F.lit("\n| "), kind, F.lit(" | "), size, F.lit(" |\nplain\n"), F.repeat(F.lit("#"), (F.col("p_size") % 5 + 1).cast("int")), F.lit(" "), kind).alias("text"))


@query(r"SELECT doc_id, count(*) AS table_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT p_partkey AS doc_id, concat('## Part ', p_partkey, chr(10), '| ', p_type, ' | ', p_size, ' |', chr(10), 'plain', chr(10), repeat('#', p_size % 5 + 1), ' ', p_type) AS text FROM part)) WHERE regexp_matches(trim(line), '^\|.*\|$') GROUP BY 1")
def table_lines(t):
    return markdown.lines(_sheets(t)).where(F.trim("line").rlike(r"^\|.*\|$")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("table_lines"))


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(regexp_extract(line, '^(#+) ', 1))::INTEGER AS level, trim(regexp_replace(line, '^#+ ', '')) AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT p_partkey AS doc_id, concat('## Part ', p_partkey, chr(10), '| ', p_type, ' | ', p_size, ' |', chr(10), 'plain', chr(10), repeat('#', p_size % 5 + 1), ' ', p_type) AS text FROM part)) WHERE regexp_matches(line, '^#{1,6} ')")
def document_headings(t):
    return markdown.headings(_sheets(t)).select("doc_id", "pos", "level", "title")


@query("SELECT sha256(text) AS hash, min(doc_id) AS keeps, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT doc_id, CAST(0.70 + 0.15 * n / 3 AS DOUBLE) AS score FROM (SELECT doc_id, contains(text, 'token')::INT + contains(text, 'password')::INT + contains(text, 'ation')::INT AS n FROM documents) WHERE n > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def phrase_search(t):
    chunks = t.documents.select(F.col("doc_id").alias("id"), "text")
    return retrieval.phrase_search(chunks, ["token", "password", "ation"], 10).select(F.col("id").alias("doc_id"), "score")


@query("""WITH s AS (SELECT doc_id, source, 0.6 + 0.3 * (contains(lower(text), 'password')::INT + contains(lower(text), 'license')::INT) / 2.0 AS score FROM documents WHERE source IN ('src0', 'src3')) SELECT doc_id, round(score, 9) AS score FROM s""")
def structural_search(t):
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("workbook"), F.lit("").alias("sheet"), F.lit("").alias("section_path"), "text")
    return retrieval.structural(chunks, ["src0", "src3"], "password license").select(F.col("id").alias("doc_id"), "score")


def _asked(t):
    return t.embeddings.groupBy("label").agg(F.min("vec_id").alias("query_id"))


@query("""WITH q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label), s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings a ON a.vec_id = q.query_id CROSS JOIN embeddings e)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def nearest_vectors(t):
    asked = _asked(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest_each(chunks, asked, 5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)::DOUBLE)), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)::DOUBLE)) DESC, vec_id LIMIT 10""")
def nearest_in_group(t):
    found = retrieval.nearest(t.embeddings.withColumnRenamed("vec_id", "id"), [1.0, -0.5] * 32, 10, where=F.col("label") == 3)
    return found.select("id", F.round("score", 6).alias("score"))


def _search_docs(t):
    parts = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("kind"), F.col("p_name").alias("title"), F.col("p_brand").alias("workbook"), F.lit("").alias("space"), F.concat_ws("/", "p_brand", "p_name").alias("path"), F.lit("").alias("summary"), F.split("p_name", " ").alias("key_terms"))
    return lexical.prepared(parts, fuzzy=False)


@query("""WITH s AS (SELECT p_partkey AS doc_id, p_type AS kind, CASE WHEN p_name = 'ring' THEN 1.0 WHEN starts_with(p_name, 'ring') THEN 0.95 WHEN contains(p_name, 'ring') THEN 0.85 ELSE 0 END AS score FROM part)
SELECT doc_id, kind, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100""")
def lexical_search(t):
    return lexical.search(_search_docs(t), "ring", 100, balance=False, fuzzy=False).select("doc_id", "kind", "score")


@query()
def lexical_fuzzy(t):
    docs = lexical.prepared(_search_docs(t).select("doc_id", "kind", "title", "workbook", "space", "path", "summary", "key_terms"))
    return lexical.search(docs, "wdget", 50)


@query("""WITH h AS (SELECT p_brand AS workbook, p_type AS sheet, p_retailprice / 1000 AS score FROM part) SELECT workbook, round_even(sum(score), 3) AS total FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def folded_hits(t):
    hits = t.part.select(F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), (F.col("p_retailprice") / 1000).alias("score"))
    return lexical.folded(hits, "workbook", "sheet", "score", 10).select("workbook", "total")


@query("""WITH b AS (SELECT p_partkey AS id, 0.8 AS b FROM part WHERE p_size < 20), v AS (SELECT p_partkey AS id, 0.5 AS v FROM part WHERE p_size BETWEEN 10 AND 30), f AS (SELECT p_partkey AS id, 0.4 AS f FROM part WHERE p_size BETWEEN 25 AND 35), p AS (SELECT p_partkey AS id, 0.75 AS p, p_type = 'PROMO' AS c FROM part WHERE p_size % 5 = 0),
i AS (SELECT id FROM b UNION SELECT id FROM v UNION SELECT id FROM f UNION SELECT id FROM p), j AS (SELECT i.id, CASE WHEN b IS NOT NULL AND v IS NOT NULL THEN b * 1.2 ELSE coalesce(b, v, f * 1.5) END AS x, p, c FROM i LEFT JOIN b USING (id) LEFT JOIN v USING (id) LEFT JOIN f USING (id) LEFT JOIN p USING (id))
SELECT id, round(CAST(CASE WHEN p IS NULL THEN x WHEN x IS NULL THEN p ELSE greatest(x, p) + CASE WHEN c THEN 0.15 ELSE 0.05 END END AS DOUBLE), 6) AS score FROM j""")
def fused_scores(t):
    layer = lambda where, score: t.part.where(where).select(F.col("p_partkey").alias("id"), F.lit(score).alias("score"), (F.col("p_type") == "PROMO").alias("compound"))
    out = retrieval.fused(layer("p_size < 20", 0.8), layer("p_size between 10 and 30", 0.5), layer("p_size between 25 and 35", 0.4), layer("p_size % 5 = 0", 0.75))
    return out.select("id", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE r AS (SELECT doc_id AS id, source AS workbook, n_chars / 1000.0::DOUBLE AS score, greatest(1, floor(length(text) * 0.5))::INTEGER AS tokens FROM documents
), own AS (SELECT *, row_number() OVER (ORDER BY workbook, score DESC, id) AS p FROM (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY score DESC, id) AS n FROM r WHERE workbook IN ('src0', 'src1', 'src2')) WHERE n <= 10
), w AS (SELECT 0::BIGINT AS p, 0::BIGINT AS used, NULL::BIGINT AS id, false AS took UNION ALL SELECT o.p, CASE WHEN used + tokens <= 60000 THEN used + tokens ELSE used END, o.id, used + tokens <= 60000 FROM w JOIN own o ON o.p = w.p + 1
), first AS (SELECT id FROM w WHERE took), room AS (SELECT 60000 - max(used) AS room, 30 - count(*) FILTER (took) AS n FROM w
), rest AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id) AS upto, row_number() OVER (ORDER BY score DESC, id) AS n FROM r WHERE id NOT IN (SELECT id FROM first))
SELECT id, workbook, score, tokens FROM r WHERE id IN (SELECT id FROM first) UNION ALL SELECT id, workbook, score, tokens FROM rest WHERE upto <= (SELECT room FROM room) AND n <= (SELECT n FROM room)""")
def assembled_context(t):
    ranked = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("workbook"), (F.col("n_chars") / 1000.0).alias("score"), X.estimated_tokens(F.col("text")).alias("tokens"))
    return retrieval.assembled(ranked, ["src0", "src1", "src2"], 30, 60000)


@query(r"SELECT token, kind, count(*) AS n FROM (SELECT DISTINCT o_orderkey, 'priority' AS kind, unnest(regexp_extract_all(o_orderpriority, '[A-Za-z_][A-Za-z0-9_]{3,}')) AS token FROM orders) GROUP BY 1, 2")
def token_places(t):
    return grid.tokens(t.orders.select(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("value")))


@query("""WITH b AS (SELECT item_id, trim(lower(regexp_replace(regexp_replace(text, '["''“”‘’`]', '', 'g'), '\\s+', ' ', 'g'))) AS q FROM benchmark), d AS (SELECT string_agg(trim(lower(regexp_replace(regexp_replace(text, '["''“”‘’`]', '', 'g'), '\\s+', ' ', 'g'))), ' ¶ ') AS all_text FROM documents)
SELECT item_id FROM b, d WHERE contains(all_text, q)""")
def passages_in_documents(t):
    """Benchmark passages that stand in some document, both without quotes and with single blanks."""
    return passages.found_in_texts(t.benchmark, t.documents, "item_id", X.quoted_form(F.col("text")), X.quoted_form(F.col("text"))).select(F.col("id").alias("item_id"))


@query("SELECT doc_id, lower(text) SIMILAR TO '.*password.*' AS found FROM documents".replace("lower(text) SIMILAR TO '.*password.*'", "contains(lower(text), 'password')"))
def keyword_hits(t):
    return t.documents.select("doc_id", X.keyword_found(F.col("text"), "Password").alias("found"))
