import hashlib
import zlib

import numpy as np
import pytest

from quarry.llm import media_columns as M
from quarry.llm.queries import op3_media_columns


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_whole_table(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op3_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(own))
        assert r.payload_sha256 == hashlib.sha256(own).hexdigest() and r.tail_crc32 == zlib.crc32(own[-32:])
        assert r.error is None and len(r.feature) == 16


def test_row_filters_round_trip():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (48, 24), dtype=np.uint8)
    for filters in (0, 1, 2, 3, 4, rng.integers(0, 5, 48)):
        assert (M.decode_png(M.encode_png(image, filters)) == image).all()


def test_broken_images_are_told():
    stored = M.encode_png(np.zeros((24, 24), np.uint8))
    for broken in (b"", stored[:20], stored[:40] + bytes([stored[40] ^ 1]) + stored[41:], b"\x89PNG\r\n\x1a\n" + stored[8:33], stored.replace(b"IHDR", b"IHDX")):
        with pytest.raises(M.MediaError):
            M.decode_png(broken)


def test_hash_is_blind_to_brightness_and_sees_structure():
    image = np.random.default_rng(1).integers(0, 200, (48, 24), dtype=np.uint8)
    assert M.low_frequency_hash(image) == M.low_frequency_hash(image + 20) != M.low_frequency_hash(image[::-1])


def test_edges(spark, edge_documents):
    stored = M.text_to_media(edge_documents)
    out = M.media_features(stored).collect()
    assert len(out) == edge_documents.count()
    for r in out:
        assert bytes(r.payload) == payload_of(r.text) and r.chunk in ("clash", None)
    null = M.media_features(spark.createDataFrame([(1, None), (2, b"no image")], "id long, media binary")).collect()
    assert null[0].payload is None and null[0].error is None and null[1].error
    assert M.media_features(M.text_to_media(edge_documents.where("false"))).count() == 0


def _plain_decode(stored):
    """Row filters by the format's definition, sample by sample; chunks taken by their lengths."""
    at, data = 8, b""
    while at < len(stored):
        size = int.from_bytes(stored[at : at + 4], "big")
        if stored[at + 4 : at + 8] == b"IDAT":
            data += stored[at + 8 : at + 8 + size]
        at += 12 + size
    raw, out, up = zlib.decompress(data), [], [0] * 24
    kinds = set()
    for y in range(0, len(raw), 25):
        kind, row, left, corner = raw[y], [], 0, 0
        kinds.add(kind)
        for x in range(24):
            p = left + up[x] - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
            left, corner = (raw[y + 1 + x] + (0, left, up[x], (left + up[x]) // 2, paeth)[kind]) & 255, up[x]
            row.append(left)
        out += row
        up = row
    return bytes(out), kinds


def _plain_feature(payload):
    """Signs of the 8 x 8 lowest cosine coefficients against their median, by sums over samples."""
    image = np.frombuffer(payload, np.uint8).astype(float).reshape(24, -1, 24).mean(axis=1)
    found = []
    for u in range(8):
        for v in range(8):
            wave = [[np.cos(np.pi * u * (2 * y + 1) / 48) * np.cos(np.pi * v * (2 * x + 1) / 48) for x in range(24)] for y in range(24)]
            found.append(round(float((image * np.array(wave)).sum()), 6))
    found[0] = 0
    middle = sorted(found)
    middle = (middle[31] + middle[32]) / 2
    return int("".join("1" if f > middle else "0" for f in found), 2)


def test_stored_form_and_feature_by_definition(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in op3_media_columns(spark, sf_dir).collect()}
    seen = set()
    for n, r in enumerate(M.text_to_media(documents).collect()):
        stored = bytes(r.media)
        payload, kinds = _plain_decode(stored)
        seen |= kinds
        assert payload == payload_of(r.text)
        assert rows[r.doc_id].media_bytes == len(stored) and rows[r.doc_id].media_sha256 == hashlib.sha256(stored).hexdigest()
        if n % 4 == 0:
            assert (int(rows[r.doc_id].feature, 16) ^ _plain_feature(payload)).bit_count() <= 1  # a coefficient may round to the median
    assert seen >= {1, 2, 3, 4}


def test_squares_choose_their_filters():
    ramp, rng = np.arange(24), np.random.default_rng(4)
    flat, down = np.zeros((24, 24), np.uint8), np.tile(rng.integers(0, 256, 24, dtype=np.uint8), (24, 1))
    across = np.tile(rng.integers(0, 256, (24, 1), dtype=np.uint8), (1, 24))
    image = np.concatenate([flat, down, across, (ramp[:, None] * 3 + ramp * 5).astype(np.uint8)])
    stored = M.encode_squares(image, np.array([len(image)]))[0]
    assert (M.decode_png(stored) == image).all() and M.filtered_rows(stored)[1::24, 0].tolist()[:3] == [0, 2, 1]


def test_repeated_rows_and_a_long_text(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab")], "doc_id long, text string").unionByName(spark.range(1).selectExpr("cast(2 as long) as doc_id", "repeat('long text of words ', 2700000) as text"))
    out = M.media_features(M.text_to_media(df).drop("text")).selectExpr("doc_id", "n_bytes", "sha2(payload, 256) as s", "error").collect()
    assert len({tuple(r) for r in out}) == 2 and all(r.error is None for r in out)
    assert {r.s for r in out} == {hashlib.sha256(payload_of(t)).hexdigest() for t in ("ab", "long text of words " * 2700000)}
