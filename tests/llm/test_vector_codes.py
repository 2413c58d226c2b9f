import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm.queries import op12_vector_codes
from quarry.llm.vector_codes import errors_by_label, nearest, vector_codes

KINDS = "vec_id long, embedding array<double>, label int"


def floors(v):
    return [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in map(float, v)]


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, floors(v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = next((len(v) for _, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]) if v and len(v) % parts == 0), None)
    fitting = [r for r in kept if len(r[1]) == length]
    if length is None:
        return [(i, None, None) for i, _, _ in kept], None
    width = length // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in fitting:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    closest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in fitting:
                own[closest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else e for xs, e in zip(own, books[p], strict=True)]
    out = []
    for i, v, label in kept:
        if len(v) != length:
            out.append((i, None, None))
            continue
        best = [closest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    codes, books = vector_codes(df, **options)
    want, digest = brute(rows, **options)
    got = [tuple(r) for r in codes.select("vec_id", "code", "error").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (books.digest() if books else None) == digest
    return codes


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op12_vector_codes(spark, sf_dir).collect()
    want, digest = brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want) and {r.codebooks_sha256 for r in got} == {digest}
    labels, sums = {r[0]: r[2] for r in rows}, {}
    for i, _, error in want:
        sums[labels[i]] = sums.get(labels[i], 0) + error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got)


def test_nearest_is_the_lowest_of_the_nearest():
    rng = np.random.default_rng(2)
    for scale, width, entries in ((2, 1, 64), (3, 4, 64), (400, 4, 64), (5, 7, 3), (1 << 25, 8, 70)):
        x, book = rng.integers(-scale, scale, (500, width)), rng.integers(-scale, scale, (entries, width))
        book[entries // 2] = book[0]
        whole = ((x[:, None] - book[None]) ** 2).sum(2)
        for kind in (np.int64, object):
            index, distance = nearest(x.astype(kind), book.astype(kind))
            assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def test_edges(spark):
    r = random.Random(4)
    vector = lambda n=32: [r.gauss(0, 1) for _ in range(n)]
    rows = [(i, vector(), None if i % 3 == 0 else i % 2) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + vector(31), 1), (202, [float("nan")] + vector(31), 1), (203, [float("-inf")] + vector(31), None), (204, vector(16), 1), (205, [], 1), (206, vector(33), 0), (None, vector(), 5)]
    rows += [(7, vector(), 0), (7, vector(), 0), rows[9], rows[9]]  # an id of three vectors, a row that comes three times
    codes = check(spark, rows)
    totals = errors_by_label(codes).collect()
    assert len(totals) == codes.count()
    for label in {x.label for x in totals}:
        own = [x for x in totals if x.label == label]
        assert {x.label_error for x in own} == {sum(x.error or 0 for x in own)}
    check(spark, rows, parts=4, entries=5, rounds=3)
    check(spark, rows[:20], parts=8, entries=256)


def test_large_components_are_exact(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], 1) for i in range(100)]
    for i, x in ((3, 1e6), (70, -3e9), (71, 2.5e17), (72, -1e300), (73, 2.0**25 + 0.5)):
        rows[i][1][i % 16] = x
    check(spark, rows)
    check(spark, rows[5:70])


def test_few_rows_and_none(spark):
    check(spark, [(5, [0.5] * 16, 1)])
    check(spark, [(5, [0.5] * 15, 1), (6, [], None)])
    codes, books = vector_codes(spark.createDataFrame([], KINDS))
    assert books is None and errors_by_label(codes).count() == 0
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([], KINDS), entries=300)


def test_hot_vector_label_and_clashing_names(spark):
    """Half of all rows are copies under unlike ids, with one label; other columns are named like the ones in use."""
    r = random.Random(5)
    rows = [(i, [1.0] * 16 if i % 2 else [r.gauss(0, 1) for _ in range(16)], 0 if i % 2 else i) for i in range(400)]
    df = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], f"{KINDS}, id int, code string, of int").repartition(5)
    codes, _ = vector_codes(df)
    want, _ = brute(rows)
    out = errors_by_label(codes).collect()
    assert sorted((x.vec_id, x.code, x.error) for x in out) == sorted(want)
    assert {x.label_error for x in out if x.label == 0} == {sum(e for i, _, e in want if i % 2 or i == 0)}
