import zlib

from pyspark.sql import functions as F

from quarry.llm import language_id as L
from quarry.llm.queries import op10_language_id


def test_held_out_accuracy(spark, sf_dir, documents):
    truth = {r.doc_id: r for r in documents.collect()}
    rows = op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    right = held = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lettered = any(map(str.isalpha, truth[r.doc_id].text or ""))
        assert (r.lang_pred == "und") == (not lettered)
        if r.held_out and lettered:
            held += 1
            right += r.lang_pred == truth[r.doc_id].lang
    assert right >= 0.95 * held


def test_costs_are_the_definition(spark):
    """Code lengths from the tables equal those of the recursive definition over plain counts."""
    import math
    from collections import Counter, defaultdict

    texts = {"a": ["abracadabra abra", "cadabra"], "b": ["banana bandana", "ban"]}
    df = spark.createDataFrame([(t, k) for k, own in texts.items() for t in own], "text string, lang string")
    model = L.fit(df, order=2)
    import pyarrow as pa

    probe = "abra banana zé"
    got = model.bits(pa.array([probe]))[0]
    for at, lang in enumerate(model.languages):
        follow = defaultdict(Counter)
        for t in texts[lang]:
            data = b"  " + t.encode()
            for i in range(2, len(data)):
                for k in range(3):
                    follow[data[i - k : i]][data[i]] += 1

        def cost(data, i, k, follow=follow):
            if k < 0:
                return 8.0
            own = follow.get(data[i - k : i])
            if not own:
                return cost(data, i, k - 1)
            total = sum(own.values()) + len(own)
            return -math.log2(own[data[i]] / total) if own[data[i]] else -math.log2(len(own) / total) + cost(data, i, k - 1)

        data = b"  " + probe.encode()
        assert abs(sum(cost(data, i, 2) for i in range(2, len(data))) - got[at]) < 1e-2


def test_edges(spark, edge_documents):
    model = L.fit_on_documents(edge_documents)
    out = L.identify(edge_documents, model).collect()
    assert len(out) == edge_documents.count()
    for r in out:
        assert r.lang_pred in ("en", "de", "und") and r.chunk in ("clash", None)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    nothing = L.fit(edge_documents.where("false"))
    assert {r.lang_pred for r in L.identify(edge_documents, nothing).collect()} == {"und"}
    assert L.identify(edge_documents.where(F.lit(False)), model).count() == 0


def test_no_language_is_left_out_of_a_bounded_sample(spark):
    """Copies count once, a long text gives a piece, and each language has a part."""
    rows = [("the same words again and again", "en")] * 3000 + [("xylophon qux " * 40000, "xx"), ("ein kurzer Satz", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    for bound in (1 << 20, 4096, 16):
        model = L.fit(df, bytes_per_language=bound)
        assert model.languages == ["de", "en", "xx"]
    named = {r.text: r.lang_pred for r in L.identify(df.select("text").distinct(), L.fit(df, bytes_per_language=1 << 16)).collect()}
    assert all(named[t] == lang for t, lang in set(rows))
    assert len(L.fit(df, bytes_per_language=1 << 16).parts[0].grams[-1].key) < 1 << 12


def test_repeated_rows_and_a_long_text(spark):
    df = spark.createDataFrame([("some words here", "en"), ("quelques mots ici", "fr")], "text string, lang string")
    model = L.fit(df)
    long = spark.range(1).selectExpr("repeat('some words here ', 3200000) as text")
    out = L.identify(df.select("text").union(df.select("text")).union(long), model).collect()
    assert len(out) == 5 and sorted(r.lang_pred for r in out) == ["en", "en", "en", "fr", "fr"]


def test_whole_table_by_plain_counts(spark, sf_dir):
    """Language and bits a byte of every small document, by the recursive definition over counts of the drawn texts."""
    import math
    from collections import Counter, defaultdict
    from functools import cache

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    learn = {(r.text, r.lang) for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text and r.lang}
    assert sum(len(t.encode()) for t, _ in learn) < 4 << 20 and max(len(t) for t, _ in learn) < 1 << 18  # nothing is left out of the sample
    follow = {lang: defaultdict(Counter) for _, lang in learn}
    for text, lang in learn:
        data = b"   " + text.encode()
        for i in range(3, len(data)):
            for k in range(4):
                follow[lang][data[i - k : i]][data[i]] += 1

    @cache
    def cost(lang, context, byte):
        own = follow[lang].get(context)
        shorter = 8.0 if not context else None
        if not own:
            return shorter if shorter is not None else cost(lang, context[1:], byte)
        total = sum(own.values()) + len(own)
        if own[byte]:
            return -math.log2(own[byte] / total)
        return -math.log2(len(own) / total) + (shorter if shorter is not None else cost(lang, context[1:], byte))

    got = {r.doc_id: r for r in op10_language_id(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (got[i].lang_pred, got[i].score, got[i].bits_per_byte) == ("und", 0.0, None)
            continue
        if len(r.text) > 4000 and i % 3:
            continue  # the longest texts would take minutes in plain Python
        data = b"   " + r.text.encode()
        bits = {lang: sum(cost(lang, data[j - 3 : j], data[j]) for j in range(3, len(data))) for lang in follow}
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best and abs(got[i].bits_per_byte - bits[best] / (len(data) - 3)) < 1e-3


def test_any_number_of_languages(spark, monkeypatch):
    """More languages than one model holds, and more bytes than one worker is sent: the result is the same."""
    rows = [("".join(chr(0x400 + 3 * n + k) for k in (0, 1, 2, 1, 0, 2)) * 3 + " common words", f"l{n:03d}") for n in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = L.fit(df)
    assert model.languages == [lang for _, lang in rows] and len(model.parts) == -(-300 // L.TOGETHER)
    asked = df.select("text", F.col("lang").alias("code lengths")).union(spark.createDataFrame([(None, None), ("12", None)], "text string, x string"))
    one = sorted(map(tuple, L.identify(asked.select("text"), model).collect()), key=str)
    assert {(t, lang) for t, lang, *_ in one if lang != "und"} == set(rows)
    monkeypatch.setattr(L, "MOST_BYTES", model.nbytes // 3)
    assert len(model.groups(L.MOST_BYTES)) >= 3
    assert sorted(map(tuple, L.identify(asked.select("text"), model).collect()), key=str) == one


def test_what_is_sent_is_bounded():
    """256 languages of 20,000 n-grams each that no other has: some models more, never more bytes at once."""
    import numpy as np

    rng = np.random.default_rng(3)
    counts = [np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)) for _ in range(L.TOGETHER)]
    part = L.build([f"l{k}" for k in range(L.TOGETHER)], 3, [(keys, np.ones(len(keys))) for keys in counts])
    groups = L.Models([part] * (256 // L.TOGETHER)).groups(L.MOST_BYTES)  # the other models are alike in size
    assert all(g.nbytes <= L.MOST_BYTES for g in groups) and len(groups) <= 12 and sum(len(g.parts) for g in groups) == 32
