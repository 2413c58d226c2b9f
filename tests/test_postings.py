import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.search import postings


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 16383, 16384], [2**62, 0, 5], rng.integers(0, 1 << 40, 5000)):
        data = postings.pack(np.array(values, np.int64))
        assert postings.unpack(data).tolist() == list(values)
    assert len(postings.pack(np.ones(1000, np.int64))) == 1000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A term in nearly all documents over several stretches of ids, some that are rare, ids far apart and negative ones."""
    r = random.Random(3)
    texts = {i * 37: "the " * r.randint(1, 3) + " ".join(r.choice(["cat", "Dog", "fish_2", "새"]) for _ in range(r.randint(0, 3))) for i in range(6000)}
    texts |= {-5: "the cat", 1 << 40: "cat the DOG dog", 7: None, 8: "", 9: "only rare"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "the cat", "x"), (9, "only again", "x")], "doc_id long, text string, term string").repartition(5)
    path = str(tmp_path_factory.mktemp("postings") / "p")
    postings.write(postings.term_counts(docs), path, buckets=8, tasks_a_bucket=2)
    texts[9] = "only rare only again"
    held = defaultdict(dict)
    for i, t in texts.items():
        for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items():
            held[w][i] = n
    return path, held


def test_all_postings_come_back(spark, stored):
    path, held = stored
    got = defaultdict(dict)
    for r in postings.opened(postings.blocks(spark, path, list(held), 8)).collect():
        assert r.id not in got[r.term]
        got[r.term][r.id] = r.count if isinstance(r.count, int) else r["count"]
    assert got == held


def test_blocks_are_bounded_sorted_and_have_their_maxima(spark, stored):
    path, held = stored
    rows = postings.blocks(spark, path, ["the"], 8).collect()
    assert len(rows) > 4 and sum(r.n for r in rows) == len(held["the"]) and max(r.n for r in rows) <= postings.BLOCK
    for r in rows:
        inside = {i: c for i, c in held["the"].items() if r.first <= i <= r.last}
        assert (len(inside), max(inside.values())) == (r.n, r.most) and r.first >> postings.STRETCH_BITS == r.last >> postings.STRETCH_BITS == r.stretch
    spans = sorted((r.first, r.last) for r in rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_terms_by_frequency(spark, stored):
    path, held = stored
    want = sorted(((-len(d), w) for w, d in held.items()))
    got = postings.by_frequency(spark, path).orderBy("rank").collect()
    assert [(r.term, r.docs, r["rank"]) for r in got] == [(w, -n, k + 1) for k, (n, w) in enumerate(want)]
    assert all((r.first, r.last, r.most) == (min(held[r.term]), max(held[r.term]), max(held[r.term].values())) for r in got)


def test_only_the_terms_buckets_are_read(spark, stored):
    path, _ = stored
    read = postings.blocks(spark, path, ["cat", "rare"], 8)
    files = {f.split("/blocks/")[1].split("/")[0] for f in read.inputFiles()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan and len(files) <= 8
    touched = {r.f.split("/blocks/")[1].split("/")[0] for r in read.selectExpr("input_file_name() AS f").distinct().collect()}
    assert 1 <= len(touched) <= 2


def test_documents_that_hold_all(spark, stored):
    path, held = stored
    for wanted in (["the", "cat"], ["THE", "dog", "fish_2"], ["rare", "only"], ["cat", "rare"], ["새"], ["cat", "cat"], ["nowhere", "the"], []):
        low = {w.lower() for w in wanted}
        ids = set.intersection(*(set(held.get(w, ())) for w in low)) if low else set()
        got = {r.id: r["count"] for r in postings.holding_all(spark, path, wanted, 8).collect()}
        assert got == {i: sum(held[w][i] for w in low) for i in ids}


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    postings.write(postings.term_counts(docs), f"{tmp_path}/p", buckets=4)
    assert postings.by_frequency(spark, f"{tmp_path}/p").count() == 0 and postings.holding_all(spark, f"{tmp_path}/p", ["a"], 4).count() == 0
