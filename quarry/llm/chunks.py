"""Documents dealt to chunks, and values dealt from chunks to buckets and back.

Several operators ask of every window of every document whether its value also
occurs elsewhere. A row for each value would be far too many, so a chunk (some MB of
text) sends each bucket one row that packs all of its values for that bucket, each
distinct value once; the bucket answers each chunk with one row. A value that a
third of all documents share reaches its bucket once from each chunk only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "chunk int, doc long, text string"
#: Text bytes of a chunk and windows of a bucket, both held by one task at a time.
CHUNK_BYTES, BUCKET_VALUES = 4 << 20, 1 << 21


def sizes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and text bytes of all documents."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def in_chunks(docs: DataFrame, id_col: str, text_col: str, n_chunks: int) -> DataFrame:
    """(chunk, doc, text). The chunk hangs on id and text, so neither a hot id nor copies fill one."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def in_order(table: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray]:
    """Ids and texts of a chunk by id; null ids come last, as the largest long."""
    ids = table["doc"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], table["text"].take(pa.array(order))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpack(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row that each came from."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    if not parts:
        return np.empty(0, dtype), np.empty(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def bucket_keys(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket (upper 31 bits) and 32-bit value of each hash."""
    bucket = ((hashes >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.uint64)
    return bucket << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


PROBES = "bucket int, chunk int, probes binary, anchors binary, repeated binary"


def probe_rows(chunk: int, keys: np.ndarray, anchor: np.ndarray | None) -> pa.Table:
    """A chunk's bucket keys as one row a bucket: distinct values, which are anchors, and which come twice."""
    if anchor is None:
        anchor = np.ones(len(keys), bool)
    order = np.argsort(keys)
    keys, anchor = keys[order], anchor[order]
    first = runs(keys)
    own = keys[first]
    is_anchor = np.logical_or.reduceat(anchor, first) if len(first) else np.empty(0, bool)
    twice = np.diff(np.r_[first, len(keys)]) > 1
    bucket, value = (own >> np.uint64(32)).astype(np.int32), (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at = np.r_[runs(bucket), len(bucket)].tolist()
    rows = [(int(bucket[a]), chunk, pack(value[a:b]), pack(value[a:b][is_anchor[a:b]]), pack(value[a:b][twice[a:b]])) for a, b in zip(at[:-1], at[1:], strict=True)]
    return columns(rows, [("bucket", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary()), ("anchors", pa.binary()), ("repeated", pa.binary())])


def columns(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], schema=pa.schema(fields))


HITS = "chunk int, bucket int, hits binary"


def shared_values(table: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk its values that are an anchor somewhere and occur twice or more over all chunks."""
    fields = [("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary())]
    values, row = unpack(table["probes"], np.uint32)
    anchors = np.unique(unpack(table["anchors"], np.uint32)[0])
    repeated = np.unique(unpack(table["repeated"], np.uint32)[0])
    both = np.sort(values.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64))
    value, row = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = runs(value)
    own = value[first]
    count = np.diff(np.r_[first, len(value)])
    hit = members(own, anchors) & ((count > 1) | members(own, repeated))
    keep = np.repeat(hit, count)
    value, row = value[keep], row[keep]
    order = np.argsort(row, kind="stable")
    value, row = value[order], row[order]
    at = np.r_[runs(row), len(row)].tolist()
    chunks, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
    return columns([(chunks[int(row[a])], bucket, pack(value[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], fields)


def hit_keys(table: pa.Table) -> np.ndarray:
    """A chunk's hits as sorted bucket keys."""
    if not table.num_rows:
        return np.empty(0, np.uint64)
    values, row = unpack(table["hits"], np.uint32)
    bucket = np.array(table["bucket"].to_pylist(), np.uint64)[row]
    return np.unique(bucket << np.uint64(32) | values.astype(np.uint64))
