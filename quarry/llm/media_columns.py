"""PNG in binary columns: writing, reading with checksum tests, and low-frequency hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_buffer

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Images are 24 samples wide and a multiple of 24 high; one square is 576 samples.
SIDE = 24
HASH_SIDE = 8
#: Bytes of samples that are worked on together.
STEP_BYTES = 2 << 20


class MediaError(ValueError):
    """A stored image that fails a structure or checksum test."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _head(width: int, height: int) -> bytes:
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))


def encode_png(samples: np.ndarray, filters: np.ndarray | int = 0, level: int = 6) -> bytes:
    """An 8-bit grey PNG of a 2-d array; ``filters`` is one row filter (0-4) or one for each row."""
    height, width = samples.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = filters
    lines[:, 1:] = np.choose(lines[:, :1], filtered(samples, np.arange(height) == 0))
    return _head(width, height) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def filtered(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows under each of the five filters; ``first`` rows have no row above."""
    left, up, corner = np.zeros((3, *samples.shape), np.uint8)
    left[:, 1:] = samples[:, :-1]
    up[1:] = samples[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]
    mean = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    return np.stack([samples, samples - left, samples - up, samples - mean, samples - _paeth(left, up, corner)])


def encode_squares(samples: np.ndarray, heights: np.ndarray, level: int = 6) -> list[bytes]:
    """PNGs of images one above the other, each a number of squares high.

    Each square has the filter that leaves the least sum of absolute differences; its first row only looks left, so
    squares don't hang on each other and a reader can undo all of them together.
    """
    first = np.zeros(len(samples), bool)
    first[np.cumsum(heights)[:-1]] = True
    first[:1] = True
    each = filtered(samples, first)
    cost = np.abs(each.view(np.int8).astype(np.int16)).sum(axis=2).reshape(5, -1, SIDE).sum(axis=2)
    kinds = np.repeat(cost.argmin(axis=0).astype(np.uint8), SIDE)
    kinds[::SIDE] = np.minimum(kinds[::SIDE], 1)
    lines = np.empty((len(samples), SIDE + 1), np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = each[kinds, np.arange(len(kinds))]
    ends = np.cumsum(heights)
    return [_head(SIDE, int(h)) + _chunk(b"IDAT", zlib.compress(lines[e - h : e].tobytes(), level)) + _chunk(b"IEND", b"") for e, h in zip(ends.tolist(), heights.tolist(), strict=True)]


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def decode_png(stored: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG. Every chunk's checksum is tested; MediaError says what is wrong."""
    lines = filtered_rows(stored)
    return unfilter(lines[:, 0], lines[:, 1:])


def filtered_rows(stored: bytes) -> np.ndarray:
    """Rows of an image as stored, each with its filter in front, after all tests of structure."""
    if stored[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise MediaError("cut off in a chunk's frame")
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(stored):
            raise MediaError(f"cut off in {kind!r}")
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body) if size == 13 else None
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an 8-bit grey image without interlacing")
    if not ended:
        raise MediaError("no end chunk")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(f"image data: {e}") from None
    if len(raw) != height * (width + 1):
        raise MediaError(f"{len(raw)} bytes for {height} rows of {width}")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if height and lines[:, 0].max() > 4:
        raise MediaError(f"row filter {lines[:, 0].max()}")
    return lines


def unfilter(kinds: np.ndarray, rows: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Samples from filtered rows; ``first`` rows (by default the first alone) have no row above.

    A row that only looks left begins a stretch that hangs on no row before it. All stretches are undone together, a
    row of each at a time, and of these the mean and Paeth rows sample by sample.
    """
    height, width = rows.shape
    if not height:
        return rows
    first = np.arange(height) == 0 if first is None else first
    begins = np.flatnonzero(first | (kinds < 2))
    size = np.diff(np.r_[begins, height])
    begins = begins[np.argsort(-size, kind="stable")]
    still = np.searchsorted(np.sort(-size), -np.arange(size.max()), "left")
    out = np.empty_like(rows)
    for j, m in enumerate(still.tolist()):
        at = begins[:m] + j
        kind = kinds[at]
        up = np.zeros((m, width), np.uint8) if not j else out[at - 1]
        own = rows[at]
        done = np.where((kind == 2)[:, None], own + up, own)
        done[kind == 1] = np.cumsum(own[kind == 1], axis=1, dtype=np.uint8)
        for k in (3, 4):
            of = np.flatnonzero(kind == k)
            if not len(of):
                continue
            over, mine = np.ascontiguousarray(up[of].T), np.ascontiguousarray(own[of].T)
            left, corner = np.zeros((2, len(of)), np.uint8)
            for x in range(width):
                guess = ((left.astype(np.uint16) + over[x]) >> 1).astype(np.uint8) if k == 3 else _paeth(left, over[x], corner)
                left, corner = mine[x] + guess, over[x]
                mine[x] = left
            done[of] = mine.T
        out[at] = done
    return out


def _cosines() -> np.ndarray:
    k, x = np.arange(HASH_SIDE)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_BASIS = _cosines()


def low_frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine coefficients of the image, shrunk to a square, exceed their median.

    Rows are averaged over equal stretches. The constant coefficient counts as 0, so overall
    brightness has no part. Needs a width of 24 and a height that is a multiple of 24.
    """
    square = samples.reshape(SIDE, -1, SIDE).mean(axis=1)
    spectrum = np.round((_BASIS @ square @ _BASIS.T).ravel(), 6)  # the last digits hang on the machine
    spectrum[0] = 0
    return np.packbits(spectrum > np.median(spectrum)).tobytes()


def text_to_media(df: DataFrame, text_col: str = "text", media_col: str = "media", size_col: str = "n_bytes", level: int = 6) -> DataFrame:
    """Adds each text's UTF-8 bytes as a PNG, and their number.

    Bytes 255 fill up to a positive multiple of 576; null and empty text give one square of 255.
    All columns stay; a column named like an added one is replaced. Equal texts have equal media, repeated rows too; an
    empty table gives no rows. Works on ``STEP_BYTES`` of text or one longer text at a time, with some 30 bytes for each.
    """
    df = df.drop(media_col, size_col)
    schema = df.withColumns({size_col: F.lit(0).cast("long"), media_col: F.lit(b"")}).schema

    def store(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_string())
            for low, high in slices(texts, STEP_BYTES):
                part = batch.slice(low, high - low)
                data, offsets = text_buffer(texts.slice(low, high - low))
                size = np.diff(offsets)
                squares = np.maximum(1, -(-size // SIDE**2))
                ends = np.cumsum(squares) * SIDE**2
                filled = np.full(int(ends[-1]), 255, np.uint8)
                filled[np.arange(len(data)) + np.repeat(ends - squares * SIDE**2 - offsets[:-1], size)] = data
                media = encode_squares(filled.reshape(-1, SIDE), squares * SIDE, level)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size, pa.int64()), pa.array(media, pa.binary())], [*part.schema.names, size_col, media_col])

    return df.mapInArrow(store, schema)


def unfiltered(held: list[tuple[int, np.ndarray]]):
    """(number, samples) of images given as stored rows; those of one width are undone together."""
    widths: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, lines in held:
        widths.setdefault(lines.shape[1], []).append((i, lines))
    for own in widths.values():
        every = np.concatenate([lines for _, lines in own])
        ends = np.cumsum([len(lines) for _, lines in own])
        first = np.zeros(len(every), bool)
        first[np.r_[0, ends[:-1]][ends > np.r_[0, ends[:-1]]]] = True
        samples = unfilter(every[:, 0], every[:, 1:], first)
        for (i, lines), end in zip(own, ends.tolist(), strict=True):
            yield i, samples[end - len(lines) : end]


FEATURES = {"payload": "binary", "media_bytes": "long", "media_sha256": "string", "low_frequency": "binary", "error": "string"}


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads stored images back and adds payload, stored size and digest, hash and error.

    Null media: all null. A broken image: null payload and hash, and ``error`` says why.
    Columns named like an added one are replaced; repeated rows are alike; an empty table gives no rows. A very long
    image is one row's work: its samples some ten times.
    """
    df = df.drop(*FEATURES)
    schema = df.withColumns({k: F.lit(None).cast(v) for k, v in FEATURES.items()}).schema

    def read(batches):
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        for batch in batches:
            stored = batch.column(media_col)
            low = 0
            while low < batch.num_rows:
                found, held, pixels = {k: [] for k in FEATURES}, [], 0
                at = low
                while at < batch.num_rows and (at == low or pixels < STEP_BYTES):
                    value, row = stored[at].as_py(), dict.fromkeys(FEATURES)
                    if value is not None:
                        row |= {"media_bytes": len(value), "media_sha256": hashlib.sha256(value).hexdigest()}
                        try:
                            held.append((at - low, filtered_rows(value)))
                            pixels += held[-1][1].size
                        except MediaError as e:
                            row["error"] = str(e)
                    for k in FEATURES:
                        found[k].append(row[k])
                    at += 1
                for i, samples in unfiltered(held):
                    found["payload"][i] = samples.tobytes()
                    if samples.shape[1] == SIDE and samples.size and samples.shape[0] % SIDE == 0:
                        found["low_frequency"][i] = low_frequency_hash(samples)
                part = batch.slice(low, at - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[k], kinds[v]) for k, v in FEATURES.items())], [*part.schema.names, *FEATURES])
                low = at

    return df.mapInArrow(read, schema)
