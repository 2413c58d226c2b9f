import base64
import hashlib
import random

import public_tokenizers
import pytest

from quarry.llm import byte_bpe as B
from quarry.llm.queries import op8_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def definition(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_whole_table(spark, sf_dir, documents, definition):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = op8_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = definition(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_texts(ranks, definition):
    """Odd alphabets, white space of all kinds and runs of repeats."""
    encoder, rng = B.Encoder(ranks, public_tokenizers.PATTERN), random.Random(2)
    letters = "ab cdeeettth  \n\t'  \x1c\x85éß日本😀0123456789.,!?-_\r\n's'll"
    for n in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        if n % 10 == 0:
            text = text[:5] * 40
        assert list(memoryview(encoder.encode(text)).cast("i")) == definition(text), repr(text)


def test_transducer_is_the_merge_rule(ranks):
    machine, rng = B.Transducer(ranks), random.Random(4)
    for _ in range(800):
        piece = bytes(rng.choice(b"abcdehinorst \xc3\xa9\xe6\x97") for _ in range(rng.randrange(1, 40)))
        assert machine.encode_piece(piece) == B.merged(ranks, piece)


def test_streams_end_in_any_place():
    text = "aé日😀z" * 3
    data = text.encode() + b"\xff\xe2\x82"
    for cut in range(1, 7):
        stream = B.Utf8Stream()
        got = "".join(stream.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + stream.close()
        assert got == data.decode("utf-8", "replace")


def test_edges(spark, edge_documents, ranks, definition):
    ids = B.bpe_encode(edge_documents, ranks, public_tokenizers.PATTERN)
    for r in B.bpe_decode(ids, ranks, text_col="again", stream_ids=3).collect():
        assert r.ids == definition(r.text or "") and r.again == (r.text or "") and r.chunk in ("clash", None)
    assert B.bpe_encode(edge_documents.where("false"), ranks, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [99999999]), (2, None), (3, []), (4, [None])], "id long, ids array<int>")
    assert [r.decoded for r in B.bpe_decode(odd, ranks).orderBy("id").collect()] == [None, None, b"", None]


def test_other_patterns_and_long_pieces(ranks):
    """A pattern whose cuts aren't known goes through the regular expression; long pieces emit window by window."""
    import tiktoken

    pattern = r"\p{L}+|[^\p{L}]"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(5)
    for text in ["it's 12  x\n\ny", "".join(rng.choice("abcdeinrst") for _ in range(5000)), "=" * 3000, "ab" * 2000 + " end", "", "日本" * 900]:
        assert list(memoryview(B.Encoder(ranks, pattern).encode(text)).cast("i")) == own(text)
        assert list(memoryview(B.Encoder(ranks, public_tokenizers.PATTERN).encode(text)).cast("i")) == known(text)


def test_states_whose_digests_meet_stay_apart(ranks, monkeypatch):
    """With digests of three bits nearly all lists of threads collide; ids stay right."""
    import numpy as np

    monkeypatch.setattr(B, "mix", lambda x: x & np.uint64(7))
    machine, rng = B.Transducer(ranks), random.Random(6)
    for _ in range(100):
        piece = bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randrange(1, 25)))
        assert machine.encode_piece(piece) == B.merged(ranks, piece)


def test_tokens_that_no_merges_reach():
    small = {bytes([b]): b for b in range(256)} | {b"abcd": 256}
    encoder = B.Encoder(small, public_tokenizers.PATTERN)
    assert list(memoryview(encoder.encode("abcd abcd")).cast("i")) == [256, 32, 97, 98, 99, 100]


def test_states_are_forgotten(ranks, monkeypatch):
    monkeypatch.setattr(B, "KEEP_STEPS", 50)
    machine, rng = B.Transducer(ranks), random.Random(7)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randrange(1, 30)))
        assert machine.encode_piece(piece) == B.merged(ranks, piece)
    long = bytes(rng.choice(b"abcde") for _ in range(1500))
    assert machine.encode_piece(long) == B.merged(ranks, long)


def test_round_trip_of_a_text_of_fifty_megabytes(spark, ranks):
    docs = spark.range(1).selectExpr("id as doc_id", "repeat('the quick Brown fox''s 12 jumps, oder über ', 1400000) as text")
    out = B.bpe_encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="again")
    assert out.selectExpr("again = text and size(ids) > 10000000").first()[0]
