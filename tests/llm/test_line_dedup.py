import hashlib
import random

from quarry.llm.line_dedup import BLANKS, line_dedup
from quarry.llm.queries import op6_line_dedup


def near(a, b):
    """Whether at most one insertion, deletion or replacement of a character leads from one to the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x == y or x[1:] == y[1:] or x[1:] == y or x == y[1:]


def brute(rows, min_chars):
    places = []
    for doc, text in rows:
        for pos, line in enumerate([] if text is None else text.split("\n")):
            if len(line.strip(BLANKS)) >= min_chars:
                places.append(((1 << 62 if doc is None else doc, pos), line.strip(BLANKS)))
    first = {}
    for at, line in sorted(places):
        first.setdefault(line, at)
    by_length = {}
    for line in first:
        by_length.setdefault(len(line), []).append(line)
    stays = {line: min(first[o] for n in (-1, 0, 1) for o in by_length.get(len(line) + n, ()) if near(line, o)) for line in first}
    gone = {at for at, line in places if stays[line] < at}
    out = {}
    for doc, text in rows:
        parts = [] if text is None else text.split("\n")
        left = [p for i, p in enumerate(parts) if ((1 << 62 if doc is None else doc), i) not in gone]
        out[doc] = (len(parts), len(parts) - len(left), None if text is None else "\n".join(left))
    return out


def result(df):
    return {r.doc_id: (r.n_lines, r.n_lines_removed, r.kept_text) for r in df.collect()}


def test_whole_table(spark, sf_dir, documents):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()], 1)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op6_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256((t or "").encode()).hexdigest()) for i, (n, g, t) in expected.items()}


def test_edited_lines(spark):
    """Lines of all lengths with zero to two random edits, runs of one character, blanks at ends, letters out of the base plane."""
    rng, rows = random.Random(6), []
    seeds = ["".join(rng.choice("aabbcdé😀 ") for _ in range(n)) for n in range(3, 40)] + ["a" * n for n in (7, 8, 9, 15, 16, 17)] + ["ab" * 12]
    for doc in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(seeds))
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(2)] = rng.choice(("", "a", "x", "😀"))
            lines.append(rng.choice(("", " ", "\t")) + "".join(line) + rng.choice(("", "\r")))
        rows.append((doc, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 9):
        assert result(line_dedup(df, min_chars=least)) == brute(rows, least)


def test_edges(spark, edge_documents):
    out = line_dedup(edge_documents, min_chars=2)
    assert set(edge_documents.columns) < set(out.columns)
    expected = brute([(r.doc_id, r.text) for r in edge_documents.collect()], 2)
    assert result(out) == expected
    twice = line_dedup(edge_documents.union(edge_documents), min_chars=2)
    assert twice.count() == 2 * edge_documents.count() and result(twice) == expected
    assert line_dedup(edge_documents.where("false")).count() == 0
