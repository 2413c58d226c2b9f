import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.queries import op13_toxicity

M = (1 << 64) - 1


def number(piece: bytes) -> int:
    """A subword's hashed number, by plain integers."""
    x = (int.from_bytes(piece, "big") | len(piece) << 56) * 0x9E3779B97F4A7C15 & M
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 & M) >> 44


def subwords(word: bytes) -> list[int]:
    framed = b" " + word + b" "
    return [number(framed[i : i + n]) for n in range(3, 7) for i in range(len(framed) - n + 1)]


def words(text: str) -> list[bytes]:
    return re.findall(rb'[^ \t-\r.,;:!?"()\[\]]+', text.encode())


def odds(model, text: str) -> float:
    each = [(math.fsum(float(model.weight[k]) for k in subwords(w)), len(subwords(w))) for w in words(text)]
    windows = [each[i : i + 4] for i in range(max(1, len(each) - 3))]
    return model.bias + max((math.fsum(s for s, _ in w) / max(1, sum(n for _, n in w)) for w in windows), default=0.0)


def told(rows):
    return rows.select("doc_id", "text"), rows.select("doc_id", "toxic")


@pytest.fixture(scope="module")
def training(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    return docs.join(labels, "doc_id").select("doc_id", "text", "toxic")


@pytest.fixture(scope="module")
def model(training):
    return toxicity.fit(*told(training.where(~toxicity.held_out())))


def test_whole_table_by_plain_sums(spark, sf_dir):
    """Every score of the small table, from the fitted numbers by the definition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op13_toxicity(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-odds(fitted, (text or "").lower())))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == (got[i].score >= 0.5) and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_subwords_are_those_of_the_definition():
    texts = ["", "a", "ab cd", "  Ünï  \t日本語\n.", "x" * 50, None, "one,two(three)[four]"]
    found = toxicity.bags(pa.array(texts))
    for d, text in enumerate(texts):
        own = words(text or "")
        low, high = found.bounds[d], found.bounds[d + 1]
        assert high - low == len(own)
        for k, word in enumerate(own):
            assert sorted(found.subword[found.word == low + k].tolist()) == sorted(subwords(word))


def test_held_out_rows_are_told(model, training):
    rows = toxicity.classify(training.where(toxicity.held_out()), model).collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert len(toxic) > 3 and min(toxic) >= 0.5 > max(clean)


def test_unseen_spellings_share_subwords(spark, model):
    """Words that no learned text holds, made from ones that are in many."""
    frame = "the house by the river {} was sold in the autumn of that year to a family"
    bad = ["idiotic", "morons", "worthlessness", "idiiot", "scummy", "losers", "trashy", "pathetically", "clownish"]
    good = ["window", "quartet", "harvest", "lanterns", "thimble"]
    rows = [(w, frame.format(w), 1) for w in bad] + [(w, frame.format(w), 0) for w in good]
    got = {r.word: r.score for r in toxicity.classify(spark.createDataFrame(rows, "word string, text string, y int"), model).collect()}
    assert min(got[w] for w in bad) > max(got[w] for w in good)
    assert sum(got[w] >= 0.5 for w in bad) >= 7 and all(got[w] < 0.5 for w in good)


def test_a_word_in_a_long_text_counts(spark, model):
    clean = "the house by the river was sold in the autumn " * 40_000
    got = toxicity.classify(spark.createDataFrame([(1, clean), (2, clean + "idiot " + clean)], "i int, text string"), model).collect()
    assert {r.i: r.predicted for r in got} == {1: 0, 2: 1}


def test_held_out_labels_are_not_learned_from(spark, sf_dir, tmp_path):
    for table in ("documents", "labels"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table == "labels":
            rows = rows.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    first, second = ({r.doc_id: (r.score, r.held_out) for r in op13_toxicity(spark, d).collect()} for d in (sf_dir, str(tmp_path)))
    assert first == second


def test_edges(spark, model, edge_documents):
    rows = toxicity.classify(edge_documents, model).collect()
    assert len(rows) == edge_documents.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not (r.text or "").strip(" \t\n\v\f\r.,;:!?")}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert [r.score for r in rows if r.text and r.text.startswith("one two")] == [rows[6].score] * 2
    assert toxicity.classify(edge_documents.where("false"), model).count() == 0
    again = toxicity.classify(toxicity.classify(edge_documents, model), model)
    assert again.columns == [*edge_documents.columns, "score", "predicted"]


def test_labels_of_one_kind_or_none(spark):
    text = spark.createDataFrame([(1, "fine words", 0), (2, None, 1), (3, "  ", 1), (4, "odd", None), (5, "seven", 7)], "doc_id long, text string, toxic int")
    assert [r.predicted for r in toxicity.classify(text, toxicity.fit(*told(text))).collect()] == [0] * 5
    assert [r.predicted for r in toxicity.classify(text, toxicity.fit(*told(text.where("false")))).collect()] == [0] * 5
    assert [r.predicted for r in toxicity.classify(text, toxicity.fit(*told(text.where("toxic = 0").withColumn("toxic", F.lit(1))))).collect()] == [1] * 5


def test_sample_is_bounded_and_copies_count_once(training, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, **_: taken.append((texts, toxic)))
    toxicity.fit(*told(training.unionByName(training)), bytes_per_class=1 << 16)
    (texts, toxic), = taken
    for y in (True, False):
        own = [t for t, z in zip(texts, toxic, strict=True) if z == y]
        assert own and len(set(own)) == len(own) and sum(len(t.encode()) for t in own) <= 1 << 16 and max(len(t.encode()) for t in own) <= 1 << 12


def test_windows_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 9, 12)
        bounds = np.r_[0, np.cumsum(lengths)]
        total, count = rng.normal(size=bounds[-1]), rng.integers(1, 9, bounds[-1])
        best, low, high = toxicity.worst(total, count, bounds)
        for d in range(12):
            a, b = bounds[d], bounds[d + 1]
            windows = [(i, min(i + 4, b)) for i in range(a, max(a + 1, b - 3))] if b > a else []
            want = max((total[i:j].sum() / count[i:j].sum() for i, j in windows), default=0)
            assert abs(best[d] - want) < 1e-9 and (not windows or abs(total[low[d] : high[d]].sum() / count[low[d] : high[d]].sum() - want) < 1e-9)


def test_pieces_have_the_windows_of_the_text():
    rng = np.random.default_rng(2)
    for size in (1, 3, 10, 50):
        for n in (0, 1, 3, 4, 5, 40):
            own = [rng.choice(list(b"abc.,"), rng.integers(1, 30)).astype(np.uint8).tobytes() for _ in range(n)]
            data = np.frombuffer(bytes(rng.choice([b" ", b"\n  ", b""])) + b" ".join(own) + bytes(rng.choice([b"", b" . "])), np.uint8)
            split = lambda part: re.findall(rb'[^ \t-\r.,;:!?"()\[\]]+', bytes(part))
            windows = lambda ws: {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))}
            found = toxicity.pieces(data, size)
            assert set().union(*(windows(split(data[a:b])) for a, b in found)) == windows(split(data))
            assert len(found) <= len(split(data)) + 1


def test_very_long_texts_are_read_in_pieces(model, monkeypatch):
    text = "the house by the river was sold " * 3000 + "pathetic " + "in the autumn of that year " * 3000
    whole = model.odds(pa.array([text]))
    monkeypatch.setattr(toxicity, "PIECE", 5000)
    assert np.allclose(model.odds(pa.array([text])), whole) and whole[0] > 0
