"""Texts of megabytes, a line and a word of half a megabyte, and many findings in one text, through the registered queries."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import queries

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(5000)]
LONG = "".join(R.choice(WORDS) + R.choice("    \n") for _ in range(300_000))
NEAR = LONG[: len(LONG) - 20_000]
LINE = " ".join(R.choice(WORDS) for _ in range(80_000))
WORD = "x1" * 250_000
FOUND = "".join(f"password=abcdef{i} and user{i}@host.example.org say\n" for i in range(8000))
TEXTS = {1: LONG, 2: NEAR, 3: LINE, 4: WORD, 5: FOUND, 6: "short text", 7: "", 8: None}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("long")
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, kinds).repartition(2).write.parquet(f"{at}/documents.parquet")
    found = queries.queries()
    return lambda name: {r.doc_id: r for r in found[name](spark, str(at)).collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substrings(results):
    got = results("op2_substring_dedup")
    assert got[1].n_words == len(LONG.split()) and got[1].n_removed == 0
    assert got[2].n_words - got[2].n_removed <= 1  # but for a last word cut in two
    assert (got[3].n_words, got[3].n_removed, got[4].n_words, got[4].kept_sha256) == (80_000, 0, 1, digest(WORD))


def test_media(results):
    got = results("op3_media_columns")
    for i, text in TEXTS.items():
        data = (text or "").encode()
        payload = data + b"\xff" * (max(-(-len(data) // 576), 1) * 576 - len(data))
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_near_copies(results):
    got = results("op5_ngram_join")
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert (got[4].n_shingles, got[6].n_shingles, got[8].n_shingles) == (1, 1, 0)


def test_lines(results):
    got = results("op6_line_dedup")
    assert got[3].n_removed == got[4].n_removed == 0
    whole = [x for x in NEAR.split("\n")[:-1] if x.strip()]
    assert got[2].n_removed >= len(whole)


def test_findings(results):
    assert results("op7_pii")[5].n_email == 8000
    assert results("op9_secret_scan")[5].n_assign == len(re.findall(r"password=abcdef\d+", FOUND)) == 8000


def test_tokens(results):
    got = results("op8_byte_bpe")
    assert all(got[i].decoded_sha256 == digest(t or "") for i, t in TEXTS.items())


def test_languages(results):
    got = results("op10_language_id")
    assert set(got) == set(TEXTS) and got[7].lang_pred == got[8].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
