import hashlib
import re

import pytest

from quarry.llm.queries import op2_substring_dedup
from quarry.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i, own in words.items():
        for a in range(len(own) - window + 1):
            key = tuple(own[a : a + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for a in range(len(own) - window + 1):
            if first[tuple(own[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


def test_whole_table(spark, sf_dir, documents):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()], 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in expected.items()}


@pytest.mark.parametrize("chunk_bytes,bucket_values", [(200, 40), (1 << 20, 1 << 20)])
def test_chunks_and_buckets(spark, documents, chunk_bytes, bucket_values):
    """Many small chunks and buckets give what one gives; self-overlapping repeats count from the first document on."""
    rows = [(r.doc_id, r.text) for r in documents.limit(25).collect()]
    rows += [(1000, "a b " * 40), (1001, "a b " * 40), (1002, "b a " * 7), (1003, "x " * 9 + "a b a b a b a b a b z"), (1004, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=8, chunk_bytes=chunk_bytes, bucket_values=bucket_values).collect()}
    assert got == brute(rows, 8)


def test_edges(spark, edge_documents):
    out = substring_dedup(edge_documents, window=5).collect()
    assert len(out) == edge_documents.count()
    by = {r.doc_id: r for r in out}
    assert by[0].n_words == 0 and by[0].kept_text == "" and by[7].n_removed == 7 and by[6].n_removed == 0
    assert by[7].spans == [0, 7]
    assert by[None].kept_text == "a null id"
    assert substring_dedup(edge_documents.where("false")).count() == 0


def test_narrow_first_hash(spark, documents):
    """With a first hash of two bits the second one tells windows apart."""
    rows = [(r.doc_id, r.text) for r in documents.limit(40).collect()]
    rows += [(1000, rows[3][1]), (1001, "a b " * 40), (1002, "a b " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=8, first_bits=2).collect()}
    assert got == brute(rows, 8)


def test_repeated_rows_and_a_long_text(spark):
    """Rows of one id leave each other's words alone; a text of 50 MB passes."""
    own = " ".join(f"w{i}" for i in range(60))
    long = spark.range(1).selectExpr("cast(9 as long) as doc_id", "array_join(transform(sequence(1, 5500000), i -> concat('word', cast(i as string))), ' ') as text")
    df = spark.createDataFrame([(1, own), (1, own), (2, own + " end")], "doc_id long, text string").unionByName(long)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(df, window=50).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(1, 60, 0), (1, 60, 0), (2, 61, 60), (9, 5500000, 0)]
