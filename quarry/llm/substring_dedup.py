"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window. Any
window of a document holds one whole block of it, so a repeated window shows itself
as a rolling block-wide window of another place that equals a reference block. Only
windows that hold such a hit are extended to whole windows, which are compared by two
independent 64-bit hashes of their words; runs of repeated windows are the maximal
repeats, and their words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .words import inside, rolling, split_words, word_hashes

_RESULT = "doc long, n_words long, n_removed long, kept_text string, spans array<int>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, chunk_bytes: int = C.CHUNK_BYTES, bucket_values: int = C.BUCKET_VALUES, first_bits: int = 64) -> DataFrame:
    """Removes every word that lies in a window whose words also start in a document with a smaller id.

    Returns a row for each input row: ``id_col``, ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by one space) and ``spans`` (first and last-plus-one
    word of each maximal repeat that was removed, one after the other).

    Null or empty text: no words, empty ``kept_text``. A null id is larger than any
    other and equal to other null ids. Rows that share an id don't remove each other's
    words. Empty input: no rows. Other columns are not read.

    Windows are judged on the input. Two are the same if both of their 64-bit hashes are, which have unlike word
    hashes and unlike bases. ``first_bits`` narrows the first one, for tests. A very long text is one task's work, with
    some 150 bytes for each of its own.
    """
    block = max(1, window // 2)
    n_rows, n_bytes = C.sizes(docs, text_col)
    n_chunks, n_buckets = 1 + n_bytes // chunk_bytes, 1 + n_bytes // 6 // bucket_values
    dealt = C.in_chunks(docs, id_col, text_col, n_chunks)

    def probe(table: pa.Table) -> pa.Table:
        _, texts = C.in_order(table)
        words = split_words(texts)
        keys, ok = rolling_keys(words, block, n_buckets)
        at = np.arange(len(keys)) - words.bounds[:-1].repeat(np.diff(words.bounds))[: len(keys)]
        return C.probe_rows(table["chunk"][0].as_py(), keys[ok], (at % block == 0)[ok])

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        fields = [("bucket", pa.int32()), ("chunk", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())]
        known = C.hit_keys(hits)
        if not table.num_rows or not len(known):
            return C.columns([], fields)
        ids, texts = C.in_order(table)
        words = split_words(texts)
        keys, ok = rolling_keys(words, block, n_buckets)
        hit = np.r_[0, np.cumsum(C.members(keys, known) & ok)]
        wholes, ok = whole_windows(words, window, first_bits)
        first = np.arange(len(wholes))
        at = np.flatnonzero((hit[first + window - block + 1] > hit[first]) & ok)
        wholes, doc = wholes[at], words.doc_of[at]
        order = in_pairs(wholes)  # documents are in order, so a run starts with its smallest
        order = order[pair_runs(wholes[order])]
        wholes, doc = wholes[order], ids[doc[order]]
        bucket = bucket_of(wholes, n_buckets)
        order = np.lexsort((doc, bucket))
        wholes, doc, bucket = wholes[order], doc[order], bucket[order]
        at = np.r_[C.runs(bucket), len(bucket)].tolist()
        chunk, rows = table["chunk"][0].as_py(), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            cuts = C.runs(doc[a:b])
            rows.append((int(bucket[a]), chunk, C.pack(doc[a:b][cuts]), C.pack(np.diff(np.r_[cuts, b - a]).astype(np.uint32)), C.pack(wholes[a:b])))
        return C.columns(rows, fields)

    def smallest(table: pa.Table) -> pa.Table:
        keys, row = C.unpack(table["keys"], PAIR)
        doc = np.repeat(C.unpack(table["docs"], np.int64)[0], C.unpack(table["counts"], np.uint32)[0])
        order = in_pairs(keys)
        first = pair_runs(keys[order])
        least = np.minimum.reduceat(doc[order], first) if len(first) else doc
        later = np.empty(len(keys), bool)
        later[order] = doc[order] > np.repeat(least, np.diff(np.r_[first, len(keys)]))
        keys, row = keys[later], row[later]
        at = np.r_[C.runs(row), len(row)].tolist()
        chunks = table["chunk"].to_pylist()
        return C.columns([(chunks[int(row[a])], C.pack(keys[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], [("chunk", pa.int32()), ("later", pa.binary())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = C.in_order(table)
        words = split_words(texts)
        wholes, ok = whole_windows(words, window, first_bits)
        doc_of = words.doc_of
        later = pair_members(wholes, C.unpack(answers["later"], PAIR)[0]) & ok
        at = np.flatnonzero(ok)
        order = at[in_pairs(wholes[at])]
        first = pair_runs(wholes[order])
        least = np.repeat(ids[doc_of[order[first]]], np.diff(np.r_[first, len(order)]))
        later[order] |= ids[doc_of[order]] > least
        turn = np.zeros(len(words.starts) + 1, np.int64)
        turn[: len(later)] += later
        turn[window : window + len(later)] -= later
        gone = np.cumsum(turn)[:-1] > 0
        return kept(ids, words, gone)

    probes = dealt.groupBy("chunk").applyInArrow(probe, C.PROBES)
    hits = probes.groupBy("bucket").applyInArrow(C.shared_values, C.HITS)
    found = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk int, docs binary, counts binary, keys binary")
    later = found.groupBy("bucket").applyInArrow(smallest, "chunk int, later binary")
    out = dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(cut, _RESULT)
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", "kept_text", "spans")


def rolling_keys(words, width: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    values = rolling(word_hashes(words), width)
    return C.bucket_keys(values, n_buckets), inside(words.bounds, width, len(values))


#: The two hashes of a whole window.
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def whole_windows(words, width: int, first_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of hashes of whole windows, from word hashes of two more seeds than the blocks have."""
    a = rolling(word_hashes(words, seed=1), width, base=0x2545F4914F6CDD1D)
    out = np.empty(len(a), PAIR)
    out["a"] = a >> np.uint64(64 - first_bits)
    out["b"] = rolling(word_hashes(words, seed=2), width, base=0x106689D45497FDB5)
    return out, inside(words.bounds, width, len(out))


def in_pairs(pairs: np.ndarray) -> np.ndarray:
    """A stable order in which equal pairs stand together."""
    order = np.argsort(pairs["a"], kind="stable")
    a, b = pairs["a"][order], pairs["b"][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        return np.lexsort((pairs["b"], pairs["a"]))
    return order


def pair_runs(pairs: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal pairs, which stand together."""
    a, b = pairs["a"], pairs["b"]
    return np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)


def pair_members(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each pair is among the known ones."""
    found = np.zeros(len(pairs), bool)
    if len(known):
        known = known[in_pairs(known)]
        at = np.flatnonzero(C.members(pairs["a"], known["a"]))
        low, high = (np.searchsorted(known["a"], pairs["a"][at], side) for side in ("left", "right"))
        while len(at):
            found[at[known["b"][low] == pairs["b"][at]]] = True
            low += 1
            on = low < high
            at, low, high = at[on], low[on], high[on]
    return found


def bucket_of(wholes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (wholes["b"] % np.uint64(n_buckets)).astype(np.int32)


def kept(ids: np.ndarray, words, gone: np.ndarray) -> pa.Table:
    """Rows of a chunk with the words that are left; bytes are copied by one mask over the chunk."""
    n, bounds = len(ids), words.bounds
    left = np.flatnonzero(~gone)
    doc = words.doc_of[left]
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(left) else left
    data = words.data.copy()
    data[words.ends[left[inner]]] = 0x20  # the byte after a word that isn't its document's last
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[left]] = 1
    edge[words.ends[left]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).view(bool) if len(data) else np.empty(0, bool)
    mask[words.ends[left[inner]]] = True
    size = np.r_[0, np.cumsum(mask)][words.offsets].astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(data[mask].tobytes())])
    total = np.r_[0, np.cumsum(gone)]
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))) if len(gone) else np.empty(0, np.int64)
    spans = [[] for _ in range(n)]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # a run may pass from one document to the next
        d = int(np.searchsorted(bounds, a, "right")) - 1
        while a < b:
            stop = min(b, int(bounds[d + 1]))
            if stop > a:
                spans[d] += [a - int(bounds[d]), stop - int(bounds[d])]
            a, d = max(a, stop), d + 1
    null = ids == np.iinfo(np.int64).max
    return pa.table({
        "doc": pa.array(ids, mask=null),
        "n_words": pa.array(np.diff(bounds)),
        "n_removed": pa.array(np.diff(total[bounds])),
        "kept_text": text.cast(pa.string()),
        "spans": pa.array(spans, pa.list_(pa.int32())),
    })
