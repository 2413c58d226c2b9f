"""SQL of the operators' queries where SQL can say them, for DuckDB."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: crc32 of an ASCII text: each character, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

def _codes_sql() -> str:
    """Two rounds of means and three assignments, as one chain of tables."""
    steps = []
    for k in range(3):
        steps.append(f"""near{k} AS (
            SELECT id, part, min({{'d': d, 'entry': entry}}) AS best FROM (
                SELECT id, part, entry, sum((x - e) * (x - e))::BIGINT AS d FROM parts JOIN book{k} USING (part, position) GROUP BY id, part, entry) GROUP BY id, part)""")
        if k < 2:
            steps.append(f"""mean{k} AS (
            SELECT part, best.entry AS entry, position, sum(x)::BIGINT AS s, count(*) AS n FROM near{k} JOIN parts USING (id, part) GROUP BY part, best.entry, position)""")
            steps.append(f"""book{k + 1} AS (
            SELECT b.part, b.entry, b.position, CASE WHEN n IS NULL THEN e ELSE (s - ((s % n) + n) % n) // n END AS e FROM book{k} b LEFT JOIN mean{k} USING (part, entry, position))""")
    chain = ", ".join(steps)
    return rf"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, len(embedding) // 16 AS width, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (SELECT id, (i - 1) // width AS part, (i - 1) % width AS position, v[i] AS x FROM kept, unnest(range(1, len(v) + 1)) AS u(i)
        ), book0 AS (SELECT part, id - 1 AS entry, position, x AS e FROM parts WHERE id <= 64
        ), {chain}, codes AS (SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY id
        ), digest AS (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, position)) AS h FROM book2
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (id), digest
    """


SQL = {
    "op1_source_mix": rf"""
        WITH d AS (
            SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len({_WORDS.format("coalesce(text, '')")}) AS tokens,
                ('0x' || substr(md5(concat_ws(':', '7', doc_id, strlen(text))), 1, 8))::BIGINT AS slot
            FROM documents
        ), p AS (SELECT *, slot % 1024 AS block, (slot // 1024) % 1024 AS part FROM d
        ), t AS (SELECT s, sum(tokens)::BIGINT AS total FROM p GROUP BY s
        ), top AS (SELECT max(total) AS hi, min(total) AS lo FROM t WHERE total > 0
        ), e AS (
            SELECT s, total, CASE WHEN total = 0 THEN 1.0 ELSE pow(total / hi, CASE WHEN hi <= 2 * lo THEN 0.0 ELSE 1 - ln(2) / ln(hi / lo) END - 1) END AS exact FROM t, top
        ), plan AS (SELECT s, floor(exact + 1e-9)::INTEGER AS passes, greatest(0, round((exact - floor(exact + 1e-9)) * total))::BIGINT AS rest FROM e
        ), o AS (
            SELECT p.*, passes, rest, ('0x' || substr(md5(concat_ws(':', '7 order', s, passes, block)), 1, 8))::BIGINT AS o1,
                ('0x' || substr(md5(concat_ws(':', '7 order', s, passes, block, part)), 1, 8))::BIGINT AS o2
            FROM p JOIN plan USING (s)
        ), b AS (SELECT s, o1, rest, sum(sum(tokens)) OVER (PARTITION BY s ORDER BY o1) AS upto, sum(tokens) AS own FROM o GROUP BY s, o1, rest
        ), border AS (SELECT s, min(o1) AS o1, min_by(rest - upto + own, o1) AS room FROM b WHERE upto > rest GROUP BY s
        ), c AS (
            SELECT s, o2, room, sum(sum(tokens)) OVER (PARTITION BY s ORDER BY o2) AS upto FROM o JOIN border USING (s, o1) GROUP BY s, o2, room
        ), inner_border AS (SELECT s, min(o2) AS o2 FROM c WHERE upto > room GROUP BY s
        ), n AS (
            SELECT o.*, passes + CASE WHEN rest <= 0 THEN 0 WHEN border.o1 IS NULL OR o.o1 < border.o1 OR (o.o1 = border.o1 AND coalesce(o.o2 < inner_border.o2, true)) THEN 1 ELSE 0 END AS times
            FROM o LEFT JOIN border USING (s) LEFT JOIN inner_border USING (s)
        ), x AS (SELECT *, unnest(range(times)) AS pass FROM n)
        SELECT doc_id, source, tokens AS n_tokens, pass::INTEGER AS pass, block::INTEGER AS block, ('0x' || substr(md5(concat_ws(':', '7', s, pass, block)), 1, 15))::BIGINT AS mix_key FROM x""",
    "op2_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
        ), h AS (SELECT doc_id, list_transform(generate_series(1, len(ws) - 49), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS hs FROM w WHERE len(ws) >= 50
        ), win AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h
        ), f AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h
        ), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN f USING (h) WHERE d < doc_id
        ), g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(generate_series(1, len(ws)), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op5_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w
        ), s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets
        ), links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id FROM sets JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) m ON m.u = doc_id""",
    "op11_turn_repair": rf"""
        WITH RECURSIVE keyed AS (
            SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations
        ), damaged AS (
            SELECT c, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM keyed, unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) WHERE fault <> 0
        ), ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged
        ), judged AS (
            SELECT *, substr(role, 1, 1) AS initial, rtrim(text, E' \t\n\x0b\x0c\r') AS core, row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again FROM ordered
        ), turns AS (
            SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY n) || initial AS pair,
                CASE WHEN core = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM judged
        ), runs(before, inserts, here) AS (VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'), ('a', 0, 'a'), ('a', 1, 'u')
        ), edits(here, letter, after, cost) AS (
            VALUES ('', 'D', '', 2), ('s', 'D', 's', 2), ('u', 'D', 'u', 2), ('a', 'D', 'a', 2), ('', 'R', 'u', 1), ('s', 'R', 'u', 1), ('u', 'R', 'a', 1), ('a', 'R', 'u', 1),
                ('', 'K', 's', 0), ('', 'K', 'u', 0), ('s', 'K', 'u', 0), ('u', 'K', 'a', 0), ('a', 'K', 'u', 0)
        ), scripts AS (
            SELECT DISTINCT c, 0::BIGINT AS n, '' AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM turns
            UNION ALL
            SELECT s.c, s.n + 1, e.after, min({{
                'cost': s.best.cost + 5 * r.inserts + e.cost + CASE WHEN e.letter <> 'D' AND t.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': s.best.audit || repeat('I', r.inserts) || e.letter}})
            FROM scripts s JOIN turns t ON t.c = s.c AND t.n = s.n + 1 JOIN runs r ON r.before = s.state JOIN edits e ON e.here = r.here
            WHERE (e.letter = 'D' OR coalesce(t.fault, '') NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.after = t.initial) GROUP BY ALL
        ), best AS (
            SELECT c, min({{'cost': best.cost + 5 * inserts, 'audit': best.audit || repeat('I', inserts)}}) AS best
            FROM scripts JOIN runs ON before = state JOIN (SELECT c, max(n) AS n FROM turns GROUP BY c) USING (c, n) WHERE here IN ('', 'a') GROUP BY c
        ), letters AS (
            SELECT c, i, best.audit[i] AS letter, len(best.audit) - len(replace(replace(replace(best.audit, 'K', ''), 'R', ''), 'I', '')) AS kept FROM best, unnest(range(1, len(best.audit) + 1)) AS u(i)
        ), placed AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w + kept % 2 AS place FROM letters WINDOW w AS (PARTITION BY c ORDER BY i)
        ), repaired AS (
            SELECT p.c, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, E'\n' ORDER BY i)) AS digest
            FROM placed p LEFT JOIN turns t ON t.c = p.c AND t.n = p.n WHERE letter <> 'D' GROUP BY p.c
        ), counts AS (
            SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c
        )
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT c, conv_id FROM keyed) k LEFT JOIN counts USING (c) LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)
    """,
    "op12_vector_codes": _codes_sql(),
}
