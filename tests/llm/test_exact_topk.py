import math

import numpy as np

from quarry.llm.exact_topk import CellFile, exact_topk, first_copies, possible
from quarry.llm.queries import op4_exact_topk


def brute(rows, asked, k):
    kept = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = [math.floor(1024 * float(x)) for x in v]
    out = []
    for q in kept:
        if asked(q):
            scores = sorted(((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op4_exact_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, lambda q: q % 100 == 0, 10)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (500, 1 << 28, 1 << 52):
        exact, queries = rng.integers(-scale, scale, (400, 12)), rng.integers(-scale, scale, (20, 12))
        lower, upper = CellFile.of(exact.astype(float)).bounds(queries.astype(float))
        scores = np.clip(exact.astype(object) @ queries.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(float)
        assert (lower <= scores).all() and (scores <= upper).all()
    lower, upper = CellFile.of(np.array([[np.inf, 1.0], [0.0, 2.0]])).bounds(np.array([[1e308, -np.inf]]))
    assert not np.isnan(lower).any() and not np.isnan(upper).any()


def test_few_are_left_to_read():
    rng = np.random.default_rng(6)
    exact = np.floor(rng.normal(size=(5000, 64)) * 128)
    found = list(possible(exact[:40], np.arange(40), np.arange(5000), [CellFile.of(exact[:3000]), CellFile.of(exact[3000:])], 10))
    assert 10 * 40 <= sum(len(q) for q, *_ in found) < 40 * 40


def test_copies_of_a_block():
    ids = np.array([9, 1, 5, 7, 3, 2])
    data = np.array([[1.0], [1.0], [1.0], [2.0], [1.0], [2.0]])
    assert sorted(ids[first_copies(ids, data, 2)].tolist()) == [1, 2, 3, 7] and len(first_copies(ids, np.empty((6, 0)), 2)) == 2


def test_edges(spark):
    rows = [(0, [0.5, 0.5]), (100, [0.5, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.25, 0.25]), (6, [0.25, 0.25]), (7, [-1.0, 0.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, block string, rank string")
    for size in (2, 1000):
        got = sorted(tuple(r)[:4] for r in exact_topk(df, df.where("vec_id % 100 = 0"), k=3, vector_block=size, tile=size, query_set=2).collect())
        assert got == brute(rows, lambda q: q % 100 == 0, 3)
    assert exact_topk(df.where("false"), df, k=3).count() == 0 and exact_topk(df, df.where("false"), k=3).count() == 0


def test_large_components_take_part(spark):
    """Only null and non-finite components bar a vector; scores that fit a long are exact."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)]
    rows[7][1][3], rows[100][1][5], rows[11][1][0] = 300000.0, -250000.25, 1e9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk(df, df.where("vec_id % 100 = 0"), k=10).collect()))
    assert got == brute(rows, lambda q: q % 100 == 0, 10) and any(r[2] == 7 for r in got) and any(r[2] == 11 for r in got)
    rows[0][1][2] = 1e300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = {r["rank"]: r["score"] for r in exact_topk(df, df.where("vec_id = 0"), k=119).collect()}
    assert len(top) == 119 and top[1] == 2**63 - 1 and top[119] == -(2**63)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()] == [(0, 1, 1, 2 * 1024**2), (0, 2, 1, 2 * 1024**2)]


def test_hot_vector_and_hot_id(spark):
    """A third of all rows is one vector under many ids, some is one row many times; ties go to the smaller id."""
    rng = np.random.default_rng(11)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else rng.normal(size=3).round(2).tolist()) for i in range(900)] + [(500, [3.0, 3.0, 3.0])] * 40
    rows = [r for r in rows if r[0] != 500 or r[1] == [3.0, 3.0, 3.0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted(map(tuple, exact_topk(df, df.where("vec_id % 100 = 0"), k=5, vector_block=64, tile=300, query_set=9).collect()))
    want = []
    for q, v in sorted({r[0]: tuple(r[1]) for r in rows if r[0] % 100 == 0}.items()):
        whole = [math.floor(1024 * x) for x in v]
        scores = sorted((-sum(a * math.floor(1024 * b) for a, b in zip(whole, w, strict=True)), i) for i, w in rows if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want
