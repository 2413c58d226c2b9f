"""Queries over wiki pages in storage format and sheets, made from the driver's pages and parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.documents import headed, storage_format, token_scan

from .book import query


def _storage(t):
    """(page_id, said, storage): each page's html as raw text in macros of nine kinds, nested, some of them never closed."""
    said, n = F.replace("url", F.lit("&"), F.lit("&amp;")), F.col("page_id").cast("string")
    raw = F.replace("html", F.lit("]]>"), F.lit(""))
    macro = lambda name, *body: F.concat(F.lit('<ac:structured-macro ac:name="'), name, F.lit('">'), *body, F.lit("</ac:structured-macro>"))
    text = lambda *x: [F.lit(y) if isinstance(y, str) else y for y in x]
    kind = F.element_at(F.array(*map(F.lit, ("info", "panel", "expand", "excerpt", "layout", "toc", "warning", "note"))), (F.col("page_id") % 8 + 1).cast("int"))
    code = macro(F.lit("code"), *text('<ac:parameter ac:name="language">html</ac:parameter><ac:plain-text-body><![CDATA[', raw, "]]></ac:plain-text-body>"))
    inner = macro(F.lit("tip"), *text("<ac:rich-text-body><p>", said, "</p>", code, "</ac:rich-text-body>"))
    outer = macro(kind, *text('<ac:parameter ac:name="title">No ', n, "</ac:parameter><ac:rich-text-body><div>", inner, "</div></ac:rich-text-body>"))
    image = F.concat(*text('<ac:image><ri:attachment ri:filename="p', n, '.png"/></ac:image>'))
    image = F.when(F.col("page_id") % 2 == 1, F.concat(*text("<table><tr><td>", image, "</td></tr></table>"))).otherwise(image)
    film = macro(F.lit("view-file"), *text('<ac:parameter ac:name="name"><ri:attachment ri:filename="f', n, F.when(F.col("page_id") % 3 == 0, ".mp4").otherwise(".pdf"), '"/></ac:parameter>'))
    link = F.concat(*text('<ac:link><ri:page ri:content-title="Page ', n, '"/></ac:link>'))
    state = macro(F.lit("status"), F.when(F.col("page_id") % 4 > 0, F.concat(*text('<ac:parameter ac:name="title">S', n, "</ac:parameter>"))).otherwise(""))
    tasks = F.concat(*text("<ac:task-list><ac:task><ac:task-status>", F.when(F.col("page_id") % 5 == 0, "complete").otherwise("incomplete"), "</ac:task-status><ac:task-body><b>", n, "</b></ac:task-body></ac:task></ac:task-list>"))
    left_open = F.when(F.col("page_id") % 3 == 0, F.concat(*text('<section><ac:structured-macro ac:name="note"><ac:rich-text-body><p>', said, "</section><p>end</p>"))).otherwise("")
    return t.pages.select("page_id", F.concat(*text("<h1>", n, "</h1>", outer, image, film, link, state, tasks, left_open)).alias("storage"))


@query("""WITH p AS (SELECT page_id, page_id::VARCHAR AS n, replace(url, '&', '&amp;') AS said, replace(replace(replace(replace(html, ']]>', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS raw FROM pages
), b AS (SELECT *, '<div><blockquote><p>💡 </p><p>' || said || '</p><pre><code class="language-html">' || raw || '</code></pre></blockquote></div>' AS body, 'p' || n || '.png' AS image, page_id % 3 = 0 AS film FROM p)
SELECT page_id, '<h1>' || n || '</h1>' || CASE page_id % 8 WHEN 0 THEN '<blockquote><p>ℹ️ </p>' || body || '</blockquote>' WHEN 1 THEN '<blockquote><p><strong>No ' || n || '</strong></p>' || body || '</blockquote>'
        WHEN 2 THEN '<details><summary>No ' || n || '</summary>' || body || '</details>' WHEN 3 THEN body WHEN 4 THEN '<div>' || body || '</div>' WHEN 5 THEN ''
        WHEN 6 THEN '<blockquote><p>⚠️ </p>' || body || '</blockquote>' ELSE '<blockquote><p>📝 </p>' || body || '</blockquote>' END
    || CASE page_id % 2 WHEN 1 THEN '<table><tr><td>![' || image || '](images/' || image || ')</td></tr></table>' ELSE '<img src="images/' || image || '" alt="' || image || '"/>' END
    || CASE WHEN film THEN '<p>[VIDEO: f' || n || '.mp4](videos/f' || n || '.mp4)</p>' ELSE '<p>[FILE: f' || n || '.pdf](images/f' || n || '.pdf)</p>' END
    || '<a href="#Page ' || n || '">Page ' || n || '</a>' || '<span>[' || CASE page_id % 4 WHEN 0 THEN 'STATUS' ELSE 'S' || n END || ']</span>'
    || '<ul><li>' || CASE page_id % 5 WHEN 0 THEN '☑ ' ELSE '☐ ' END || n || '</li></ul>'
    || CASE WHEN film THEN '<section><blockquote><p>📝 </p><p>' || said || '</p></blockquote></section><p>end</p>' ELSE '' END AS html,
    image || CASE WHEN film THEN '' ELSE ',f' || n || '.pdf' END AS images, CASE WHEN film THEN 'f' || n || '.mp4' ELSE '' END AS videos FROM b""")
def page_macros(t):
    """Whole pages with macros in macros as plain HTML, and the names of what is attached."""
    out = _storage(t).select("page_id", storage_format.macros_to_html("storage").alias("out"))
    return out.select("page_id", "out.html", F.array_join("out.images", ",").alias("images"), F.array_join("out.videos", ",").alias("videos"))


@query("""WITH p AS (SELECT page_id, page_id::VARCHAR AS n, regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g') AS said FROM pages)
SELECT page_id, '# Page ' || n || chr(10) || chr(10) || CASE WHEN page_id % 7 = 0 THEN '(빈 페이지)' ELSE '## ' || trim(said) || chr(10) || chr(10) || '> ⚠️' || chr(10) || '>' || chr(10) || '> ' || trim(said) || chr(10) || '>' || chr(10)
    || '> > **' || n || '**' || chr(10) || '> >' || chr(10) || '> > inner ' || n || chr(10) || chr(10) || '```' || chr(10) || '<' || trim(said) || '>' || chr(10) || '```' || chr(10) || chr(10) || '| a | [' || n || '] |' || chr(10) || '| --- | --- |' END || chr(10) AS markdown FROM p""")
def page_macros_markdown(t):
    """Markdown of pages whose macros hold one another: a notice around a panel, code, a label in a table; each seventh page is empty."""
    said, n = F.trim(F.regexp_replace("url", "[^A-Za-z0-9]+", " ")), F.col("page_id").cast("string")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    panel = text('<ac:structured-macro ac:name="panel"><ac:parameter ac:name="title">', n, "</ac:parameter><ac:rich-text-body><p>inner ", n, "</p></ac:rich-text-body></ac:structured-macro>")
    notice = text('<ac:structured-macro ac:name="warning"><ac:rich-text-body><p>', said, "</p>", panel, "</ac:rich-text-body></ac:structured-macro>")
    code = text('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[<', said, ">]]></ac:plain-text-body></ac:structured-macro>")
    table = text('<table><tr><td>a</td><td><ac:structured-macro ac:name="status"><ac:parameter ac:name="title">', n, "</ac:parameter></ac:structured-macro></td></tr></table>")
    page = F.when(F.col("page_id") % 7 == 0, '<ac:structured-macro ac:name="toc"/>').otherwise(text("<h2>", said, "</h2>", notice, code, table))
    pages = t.pages.select("page_id", text("Page ", n).alias("title"), storage_format.macros_to_html(page)["html"].alias("html"))
    return pages.select("page_id", storage_format.to_markdown(F.col("html"), F.col("title")).alias("markdown"))


_BLOCKS = """SELECT p_brand AS sheet, p_size % 3 AS kind, p_name AS n, p_type AS ty, p_size::VARCHAR AS s, 4 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) + 1 AS first FROM part"""


@query(f"""WITH b AS ({_BLOCKS})
SELECT sheet, (first + CASE kind WHEN 2 THEN 1 ELSE 0 END)::INTEGER AS start, p::INTEGER AS part, CASE WHEN kind = 2 THEN CASE p WHEN 0 THEN 'L ' || n ELSE 'R ' || ty END END AS label,
    CASE x WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE first + CASE kind WHEN 0 THEN 1 ELSE 2 END END::INTEGER AS row,
    CASE kind WHEN 0 THEN ['| name | type | size |', '| --- | --- | --- |', '| ' || n || ' | ' || ty || ' | ' || s || ' |'][x + 1]
        WHEN 1 THEN ['| a | b | c | d |', '| --- | --- | --- | --- |', '| ' || n || ' | ' || ty || ' | ' || s || ' | x |'][x + 1]
        ELSE [CASE p WHEN 0 THEN '| a | b | c |' ELSE '| d | e | f |' END, '| --- | --- | --- |', CASE p WHEN 0 THEN '| ' || n || ' | ' || ty || ' |  |' ELSE '| ' || s || ' |  | ' || n || ' |' END][x + 1] END AS line
FROM b, unnest([0, 1, 2]) AS u(x), unnest(CASE kind WHEN 2 THEN [0, 1] ELSE [0] END) AS v(p)""")
def sheet_tables(t):
    """Tables of three shapes on a sheet for each brand: a header, group headers over merged cells, two tables side by side."""
    place = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    block = t.part.select(F.col("p_brand").alias("sheet"), (F.col("p_size") % 3).alias("kind"), F.col("p_name").alias("n"), F.col("p_type").alias("ty"), F.col("p_size").cast("string").alias("s"), (4 * (place - 1) + 1).alias("first"))

    def cell(row: int, col: int, value):
        return F.struct((F.col("first") + row).alias("row"), F.lit(col).alias("col"), (F.lit(value) if isinstance(value, str) else value).alias("value"))

    n, ty, s = F.col("n"), F.col("ty"), F.col("s")
    line = lambda row, *values: [cell(row, i + 1, v) for i, v in enumerate(values) if v is not None]
    plain = F.array(*line(0, "name", "type", "size"), *line(1, n, ty, s))
    grouped = F.array(*line(0, "One", None, "Two", "Three"), *line(1, "a", "b", "c", "d"), *line(2, n, ty, s, "x"))
    beside = F.array(*line(0, F.concat(F.lit("L "), n), None, None, None, F.concat(F.lit("R "), ty)), *line(1, "a", "b", "c", None, "d", "e", "f"), *line(2, n, ty, None, None, s, None, n))
    cells = block.select("sheet", F.inline(F.when(F.col("kind") == 0, plain).when(F.col("kind") == 1, grouped).otherwise(beside)))
    span = lambda low, high: F.struct(F.col("first").alias("min_row"), F.lit(low).alias("min_col"), F.col("first").alias("max_row"), F.lit(high).alias("max_col"))
    merges = block.where("kind = 1").select("sheet", F.inline(F.array(span(1, 2))))
    return headed.markdown_rows(*headed.headed_tables(cells, merges))


def _named_tables(t):
    """Typed tables whose values hold names in camel case, with underscores and in capitals."""
    camel = lambda c: F.replace(F.initcap(c), F.lit(" "), F.lit(""))
    part = t.part.select(F.col("p_partkey").cast("string").alias("PartKey"), camel("p_name").alias("part_name"), F.concat_ws("_", "p_type", F.concat(F.lit("SIZE"), "p_size")).alias("SizeClass"), "p_size")
    bought = t.lineitem.join(t.part.select("p_partkey", camel("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    line = bought.select(F.concat_ws("_", F.lit("Line"), F.concat(F.lit("Q"), F.col("l_orderkey").cast("string"))).alias("LineKey"), F.concat(F.lit("see "), "name", F.lit(" or "), "l_returnflag").alias("note"), "l_quantity")
    sold = t.orders.select(F.col("o_orderkey").alias("order_key"), F.concat(F.lit("Buyer_C"), F.col("o_custkey").cast("string")).alias("BuyerName"))
    return {"PartSheet": part, "lines": line, "ORDER": sold}


def _places(t):
    named = _named_tables(t)
    return token_scan.places(token_scan.cells_of_tables(named, "ShopBook"), token_scan.sheets_of_tables(named, "ShopBook"))


_PLACES = r"""WITH camel AS (SELECT p_partkey, p_type, p_size, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS name FROM part
), cells AS (
    SELECT 'PartSheet' AS sheet, 'kv-key' AS kind, 1 AS col, 'PartKey' AS header, p_partkey::VARCHAR AS key, p_partkey::VARCHAR AS cell FROM camel UNION ALL SELECT 'PartSheet', 'cell', 2, 'part_name', p_partkey::VARCHAR, name FROM camel
    UNION ALL SELECT 'PartSheet', 'cell', 3, 'SizeClass', p_partkey::VARCHAR, p_type || '_SIZE' || p_size FROM camel
    UNION ALL SELECT 'lines', 'kv-key', 1, 'LineKey', 'Line_Q' || l_orderkey, 'Line_Q' || l_orderkey FROM lineitem JOIN camel ON p_partkey = l_partkey
    UNION ALL SELECT 'lines', 'cell', 2, 'note', 'Line_Q' || l_orderkey, 'see ' || name || ' or ' || l_returnflag FROM lineitem JOIN camel ON p_partkey = l_partkey
    UNION ALL SELECT 'ORDER', 'cell', 2, 'BuyerName', o_orderkey::VARCHAR, 'Buyer_C' || o_custkey FROM orders
    UNION ALL SELECT * FROM (VALUES ('PartSheet', 'header', 1, 'PartKey', NULL, 'PartKey'), ('PartSheet', 'header', 2, 'part_name', NULL, 'part_name'), ('PartSheet', 'header', 3, 'SizeClass', NULL, 'SizeClass'), ('PartSheet', 'header', 4, 'p_size', NULL, 'p_size'),
        ('lines', 'header', 1, 'LineKey', NULL, 'LineKey'), ('lines', 'header', 2, 'note', NULL, 'note'), ('lines', 'header', 3, 'l_quantity', NULL, 'l_quantity'), ('ORDER', 'header', 1, 'order_key', NULL, 'order_key'), ('ORDER', 'header', 2, 'BuyerName', NULL, 'BuyerName'))
), found AS (
    SELECT unnest(list_distinct(list_concat(list_concat(regexp_extract_all(cell, '\b[A-Z][a-zA-Z0-9]+(?:_[A-Z][a-zA-Z0-9]+)+\b'), regexp_extract_all(cell, '\b[A-Z][a-z]{1,}(?:[A-Z][a-z0-9]+){1,}\b')), regexp_extract_all(cell, '\b[A-Z]{3,}(?:_[A-Z0-9]{2,})+\b')))) AS token,
        sheet, kind, col, header, key FROM cells
), places AS (
    SELECT *, CASE kind WHEN 'header' THEN 3 WHEN 'kv-key' THEN 5 ELSE 6 END AS rank FROM found WHERE length(token) >= 4
    UNION ALL SELECT 'PartSheet', 'PartSheet', 'sheet', NULL, NULL, NULL, 2 UNION ALL SELECT 'lines', 'lines', 'sheet', NULL, NULL, NULL, 2 UNION ALL SELECT 'ShopBook', '', 'filename', NULL, NULL, NULL, 1
)"""


@query(_PLACES + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY sheet, rank, key NULLS FIRST, col) AS place FROM places)
SELECT token, count(*) AS count, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds,
    string_agg(sheet || '/' || kind || '/' || coalesce(header, '') || '/' || coalesce(key, ''), ' ' ORDER BY place) FILTER (place <= 3) AS first FROM numbered GROUP BY token""")
def token_index(t):
    """Names in all cells of several tables with their first three places."""
    out = token_scan.index(_places(t), 3)
    place = lambda x: F.concat_ws("/", x["sheet"], x["kind"], F.coalesce(x["header"], F.lit("")), F.coalesce(x["key"], F.lit("")))
    return out.select("token", "count", F.array_join("kinds", ",").alias("kinds"), F.array_join(F.transform("first", place), " ").alias("first"))


@query(_PLACES + " SELECT kind, count(DISTINCT token) AS tokens, count(*) AS places FROM places GROUP BY kind")
def tokens_of_kinds(t):
    return token_scan.tokens_by_kind(_places(t))
