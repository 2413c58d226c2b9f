"""Words, hashes and rolling windows of whole Arrow columns, for use inside tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses
those bytes inside a longer character, so working on bytes gives the same words
as working on characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that one vectorised step works on; bounds its memory to about 60 bytes a byte.
STEP_BYTES = 4 << 20


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    _, offsets, data = array.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    low = int(offsets[0])
    data = np.frombuffer(data, np.uint8)[low : int(offsets[-1])] if data is not None else np.empty(0, np.uint8)
    return data, offsets - low


def slices(column, step: int = STEP_BYTES):
    """Row ranges of a string column whose texts have about ``step`` bytes (a longer text stands alone)."""
    _, offsets = text_buffer(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + step, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


@dataclass
class Words:
    """Words of a batch: byte ranges, and ``bounds[d]:bounds[d + 1]`` are the words of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(column, lower: bool = False) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    before = np.ones(len(data), bool)
    after = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    before[offsets[filled]] = True
    after[offsets[filled + 1] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a round for all ranges at once."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    left = ends - starts
    out = (left.astype(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at, who = starts, None
    while len(left):
        chunk = eight[at] & masks[np.minimum(left, 8)]
        if who is None:
            out = mix(out ^ chunk)
        else:
            out[who] = mix(out[who] ^ chunk)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends, seed)


def rolling(hashes: np.ndarray, length: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Order-dependent hashes of every ``length`` consecutive values, by doubling; result i starts at i."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, result, power, width = 0, None, hashes, 1
    rest = length
    while rest:
        if rest & 1:
            if result is None:
                result, done = power, width
            else:
                size = len(hashes) - done - width + 1
                result = result[:size] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + size]
                done += width
        rest >>= 1
        if rest:
            size = len(hashes) - 2 * width + 1
            power = power[:size] * np.uint64(pow(base, width, 1 << 64)) + power[width : width + size]
            width *= 2
    return mix(result[:n])


def inside(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """For windows 0..n-1 of ``length`` words: whether the window lies in one document."""
    ok = np.ones(n, bool)
    for cut in range(1, length):
        at = bounds[1:-1] - cut
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def shingle_sets(column, length: int, lower: bool = True) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles of ``length`` words.

    A document with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    words = split_words(column, lower)
    hashes = word_hashes(words)
    windows = rolling(hashes, length)
    sets = []
    for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if high - low >= length:
            own = np.sort(windows[low : high - length + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif high > low:
            sets.append(rolling(hashes[low:high], high - low) ^ np.uint64(high - low))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
