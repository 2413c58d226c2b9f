"""Queries over forms of names and texts, texts with headings, and files that are written from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.documents import markdown
from quarry.functions import colours, udfs
from quarry.functions import text as X
from quarry.lineage import shared_dir
from quarry.operators import graph
from quarry.sources import files
from quarry.streaming import logs

from .book import query


@query(r"""WITH p AS (SELECT *, p_type || ' - ' || p_name || '_' || p_brand AS said FROM part
), g AS (SELECT *, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) AS a, list_distinct(list_transform(range(1, length('small widget')), lambda i: substr('small widget', i, 2))) AS b,
    list_max(list_filter(range(0, least(length(p_name), 12) + 1), lambda n: left(p_name, n) = left('small widget', n))) AS pre FROM p
), h AS (SELECT *, list_max(list_filter(range(0, least(length(p_name), 12) - pre + 1), lambda n: right(p_name, n) = right('small widget', n))) AS suf FROM g)
SELECT p_partkey, regexp_replace(lower(said), '[\s_.-]+', '', 'g') AS joined, len(a)::INTEGER AS bigrams, len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) AS overlap, p_name AS title, replace(lower(p_name), ' ', '') || lower(p_type) AS deep,
    lower(p_name || ' ' || p_type) AS quoted, left(p_name, pre) AS prefix, substr(p_name, pre + 1, length(p_name) - pre - suf) AS own_rest, substr('small widget', pre + 1, 12 - pre - suf) AS other_rest, right(p_name, suf) AS suffix,
    p_size % 3 = 0 AS natural, p_name || ' ㄱㅓㅁㅅㅐㄱ' AS letters, CASE p_size % 2 WHEN 0 THEN p_size || '%' ELSE 'TRUE' END AS shown FROM h""")
def name_forms(t):
    """Forms in which names are compared: joined, bigrams, without numbers, deep, quoted, common ends, letters, as shown."""
    n, other = F.col("p_name"), F.lit("small widget")
    size = F.col("p_size").cast("string")
    number = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), size, F.lit(") "))).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(".2. "))).otherwise("③ ")
    ends = X.common_ends(n, other)
    deep = F.concat(F.lit("- **"), n, F.lit("**\n---\n2) `"), F.col("p_type"), F.lit("`\n"))
    asked = F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", n, F.lit("for sale"))).otherwise(F.replace(n, F.lit(" "), F.lit("")))
    return t.part.select(
        "p_partkey", X.joined_form(F.concat(F.col("p_type"), F.lit(" - "), n, F.lit("_"), F.col("p_brand"))).alias("joined"), F.size(X.bigrams(n)).alias("bigrams"), X.overlap_ratio(X.bigrams(n), X.bigrams(other)).alias("overlap"),
        X.without_number(F.concat(number, n)).alias("title"), X.deep_form(deep).alias("deep"), X.quoted_form(F.concat(F.lit(" “"), n, F.lit("”\n '"), F.col("p_type"), F.lit("' "))).alias("quoted"),
        ends["prefix"].alias("prefix"), ends["left_rest"].alias("own_rest"), ends["right_rest"].alias("other_rest"), ends["suffix"].alias("suffix"), X.is_natural(asked).alias("natural"), udfs.jamo(F.concat(n, F.lit(" 검색"))).alias("letters"),
        F.when(F.col("p_size") % 2 == 0, X.shown_value((F.col("p_size") / 100).cast("string"), F.lit("percent"))).otherwise(X.shown_value(F.lit("true"), F.lit("boolean"))).alias("shown"),
    )


@query("""SELECT p_partkey, 0 AS place, 'Books/' || p_brand AS path, p_name AS section FROM part UNION ALL SELECT p_partkey, 1, 'Books/' || p_brand, p_type FROM part WHERE p_type <> p_name UNION ALL SELECT p_partkey, 2, 'Other (' || p_size || ').md', '' FROM part""")
def cited_paths(t):
    """Sources named in answers, some by "same as above", with brackets in a path."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    answer = F.concat(F.lit("So (source: Books/"), F.col("p_brand"), F.lit(" § "), n, F.lit("; same as above § "), F.col("p_type"), F.lit(") and (출처: Other ("), size, F.lit(").md) or (source: never closed"))
    return t.part.select("p_partkey", F.posexplode(udfs.citations(answer)).alias("place", "c")).select("p_partkey", "place", "c.path", "c.section")


@query("""SELECT p_partkey, place, kind, text FROM (SELECT p_partkey, unnest([0, 1, 2, 3, 4]) AS place, unnest(['same', 'removed', 'added', 'same', 'added']) AS kind, unnest(['see ', 'x' || p_partkey, 'y' || p_size, ' of it', ' more' || p_partkey]) AS text FROM part)""")
def word_diffs(t):
    """What was taken out and put in, word by word."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    before, after = F.concat(F.lit("see x"), k, F.lit(" of it")), F.concat(F.lit("see y"), s, F.lit(" of it more"), k)
    return t.part.select("p_partkey", F.posexplode(udfs.word_diff(before, after)).alias("place", "d")).select("p_partkey", "place", F.col("d.type").alias("kind"), "d.text")


_HEADED = """d AS (SELECT doc_id, replace(replace(coalesce(text, ''), '#', '+'), chr(10), ' ') AS body, source FROM documents)"""


def _headed(t):
    """All documents under headings, with a table, an image, an empty section and one of a few words."""
    body = F.translate(F.coalesce("text", F.lit("")), "#\n", "+ ")
    return t.documents.select("doc_id", F.concat(F.lit("# Title\nintro\n## Body "), F.coalesce("source", F.lit("")), F.lit("\n"), body, F.lit("\n## Empty\n\n## Table\n| a | b |\n![i](x.png)\n### Sub\nend\n")).alias("text"))


@query(f"""WITH {_HEADED}, s AS (SELECT doc_id, 0 AS position, 'Title' AS heading, 'intro' AS text FROM d UNION ALL SELECT doc_id, 1, trim('Body ' || coalesce(source, '')), trim(body, chr(9) || chr(10) || chr(13) || ' ') FROM d
UNION ALL SELECT doc_id, 3, 'Table', '| a | b |' || chr(10) || '![i](x.png)' || chr(10) || '### Sub' || chr(10) || 'end' FROM d) SELECT * FROM s WHERE text <> ''""")
def headed_sections(t):
    return markdown.sections(_headed(t))


@query(f"""WITH {_HEADED}, s AS (SELECT doc_id, 0 AS position, 'Title' AS heading, 'intro' AS text FROM d UNION ALL SELECT doc_id, 1, trim('Body ' || coalesce(source, '')), trim(body, chr(9) || chr(10) || chr(13) || ' ') FROM d
UNION ALL SELECT doc_id, 3, 'Table', '| a | b |' || chr(10) || '![i](x.png)' || chr(10) || '### Sub' || chr(10) || 'end' FROM d
), k AS (SELECT *, greatest(1, floor(length(text) * 0.5))::INTEGER AS tokens FROM s WHERE text <> ''), m AS (SELECT *, max(tokens) OVER (PARTITION BY doc_id) >= LEAST AS longer FROM k
), o AS (SELECT doc_id, position, heading, text FROM m WHERE longer AND tokens >= LEAST UNION ALL SELECT doc_id, min(position), min_by(heading, position), string_agg(text, chr(10) || chr(10) ORDER BY position) FROM m WHERE NOT longer GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1)::INTEGER AS chunk, heading, greatest(1, floor(length(text) * 0.5))::INTEGER AS tokens, regexp_matches(text, '\\|.*\\|.*\\|') AS has_table, contains(text, '![i](') AS has_images, sha256(text) AS digest FROM o"""
    .replace("LEAST", str(markdown.LEAST_TOKENS)))
def headed_chunks(t):
    return markdown.chunks(_headed(t)).select("doc_id", "chunk", "heading", "tokens", "has_table", "has_images", F.sha2("text", 256).alias("digest"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def json_lines(t):
    """Rows that were appended to JSON lines in two batches, read again without the lines that are broken."""
    at = f"{shared_dir(t.spark)}/quarry/lines-{uuid.uuid4().hex}"
    nations = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    files.append_jsonl(nations, at)
    files.append_jsonl(t.supplier.select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_name").alias("n_name")), at)
    t.nation.select(F.concat(F.lit('{"n_nationkey": '), "n_nationkey", F.lit(', "n_name": "cut')).alias("value")).write.mode("append").text(at)
    return files.read_jsonl(t.spark, at, "n_nationkey bigint, n_name string, r_name string")[0]


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, event_type || ' ' || left(props, 8) AS message, CAST(ts AS DATE)::VARCHAR AS day FROM events WHERE user_id % 4 < 2 AND event_type <> 'view'""")
def ingested_logs(t):
    """Log rows that a stream has read from files and written by day: those of known sources with a message, with known levels."""
    at = f"{shared_dir(t.spark)}/quarry/logs-{uuid.uuid4().hex}"
    source = F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string"))
    message = F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", F.left("props", F.lit(8))))
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), source.alias("source"), F.upper("event_type").alias("level"), message.alias("message"))
    rows.write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    logs.ingest(stream, f"{at}/out", f"{at}/checkpoint", ("src0", "src1"), {"availableNow": True}).awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select("event_id", "level", "message", F.col("day").cast("string").alias("day"))


@query("""WITH t(number, r, g, b) AS (VALUES (0, 255, 255, 255), (1, 0, 0, 0), (2, 231, 230, 230), (3, 68, 84, 106), (4, 68, 114, 196), (5, 237, 125, 49), (6, 165, 165, 165), (7, 255, 192, 0), (8, 91, 155, 213), (9, 112, 173, 71), (10, 255, 255, 255), (11, 255, 255, 255)
), p AS (SELECT p_partkey, (p_size % 12)::INTEGER AS number, (p_size - 25) / 20.0::DOUBLE AS tint FROM part
), c AS (SELECT p_partkey, unnest([1, 2, 3]) AS i, unnest([r, g, b]) AS v, tint FROM p JOIN t USING (number))
SELECT p_partkey, string_agg(printf('%02X', least(255, greatest(0, trunc(CASE WHEN tint > 0 THEN v + (255 - v) * tint WHEN tint < 0 THEN v * (1 + tint) ELSE v END)))::INTEGER), '' ORDER BY i) AS colour FROM c GROUP BY 1""")
def theme_colours(t):
    return t.part.select("p_partkey", colours.theme_colour((F.col("p_size") % 12).cast("int"), (F.col("p_size") - 25) / 20.0).alias("colour"))


def system_texts(t):
    """A text for each brand that refers to others by prefix, cell, heading and declaration."""
    b = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    name = lambda k: F.concat(F.lit("Brand"), ((F.col("b") * k) % 25 + 1).cast("string"))
    text = F.concat(F.lit("## About "), name(7), F.lit("\nuses 'PK_"), name(3), F.lit("', and "), name(5), F.lit("!B2 or Sheet1!A1\n#### not "), name(9), F.lit("\n"))
    brands = t.part.select(b.alias("b")).distinct()
    return brands.select(F.concat(F.lit("PK_Brand"), F.col("b").cast("string")).alias("system"), text.alias("text"), F.array(F.lit("Sheet1")).alias("sheets"), F.array(F.concat(name(11), F.lit(" 시스템"))).alias("declared"))


_REFERENCES = """b AS (SELECT DISTINCT replace(p_brand, 'Brand#', '')::INTEGER AS b FROM part
), s AS (SELECT 'PK_Brand' || b AS source, 'Brand' || b AS short, 'Brand' || ((b * 3) % 25 + 1) AS n3, 'Brand' || ((b * 5) % 25 + 1) AS n5, 'Brand' || ((b * 7) % 25 + 1) AS n7, 'Brand' || ((b * 11) % 25 + 1) AS n11 FROM b
), found AS (
    SELECT source, 'PK_' || n3 AS ref, 'prefix' AS rule FROM s WHERE 'PK_' || n3 <> source
    UNION SELECT a.source, coalesce(min(k.source) FILTER (k.short = a.n5), min(k.source) FILTER (contains(k.short, a.n5) OR contains(a.n5, k.short))), 'cell' FROM s a JOIN s k ON contains(k.short, a.n5) OR contains(a.n5, k.short) GROUP BY a.source
    UNION SELECT a.source, k.source, 'heading' FROM s a JOIN s k ON contains('About ' || a.n7, k.short) AND k.source <> a.source
    UNION SELECT a.source, min(k.source), 'declared' FROM s a JOIN s k ON (contains(k.short, a.n11) OR contains(a.n11 || ' 시스템', k.short)) AND k.source <> a.source GROUP BY a.source
)"""


@query(f"WITH {_REFERENCES} SELECT * FROM found")
def extracted_edges(t):
    """What systems refer to, by rule."""
    return graph.extracted_edges(system_texts(t))


@query(f"WITH {_REFERENCES}, e AS (SELECT source, ref FROM found WHERE source <> ref AND ref IN (SELECT source FROM s)) SELECT source AS src, ref AS dst FROM e UNION SELECT ref, source FROM e")
def related_systems(t):
    """The same with names resolved to systems, in both directions."""
    return graph.related_systems(system_texts(t))
