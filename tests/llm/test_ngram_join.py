import random
import re

import numpy as np

from quarry.llm.ngram_join import ngram_join, prefix_matches
from quarry.llm.queries import op5_ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(_LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = result(op5_ngram_join(spark, sf_dir))
    assert got == brute(rows, 4, 85)


def test_near_copies_of_all_degrees(spark):
    """Copies of several originals with edits around the threshold, chains, and a passage that many share; small blocks and chunks."""
    rng, rows = random.Random(9), []
    common = [f"c{i}" for i in range(60)]
    for origin in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 150))] + (common if origin % 2 else [])
        for _ in range(18):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(3000)}"
            rows.append((len(rows) * 3 % 331, " ".join(words)))
            if rng.random() < 0.3:
                base = words  # copies of copies
    rows += [(1000 + i, " ".join([*common, *(f"own{i}_{j}" for j in range(rng.randrange(2, 14)))])) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a b c"), (2005, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 4, 85)
    assert len({c for _, c in expected.values()}) < len(rows) - 40
    assert result(ngram_join(df, chunk_bytes=3000, bucket_values=300, block=7)) == expected
    assert result(ngram_join(df, percent=60)) == brute(rows, 4, 60)


def test_longer_prefixes_for_costly_candidates():
    assert prefix_matches(np.array([1] * 30 + [2] * 170), 200, 85) >= 1
    cheap = prefix_matches(np.array([1] * 30 + [2] * 170), 200, 85)
    costly = prefix_matches(np.array([5000] * 200), 200, 85)
    assert costly > 8 > cheap


def test_edges(spark, edge_documents):
    got = result(ngram_join(edge_documents))
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    assert len(got) == len(rows)
    assert got[6] == (4, 6) and got[7] == (4, 6) and got[0] == (0, 0) and got[None] == (1, None)
    twice = ngram_join(edge_documents.union(edge_documents))
    assert twice.count() == 2 * len(rows) and result(twice) == got
    assert ngram_join(edge_documents.where("false")).count() == 0


def test_narrow_first_digest(spark, sf_dir, documents):
    """With a first digest of two bits the second one tells sets apart."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(documents, digest_bits=2).collect()}
    assert got == brute(rows, 4, 85)
