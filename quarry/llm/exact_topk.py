"""Exact top-k by inner product with vector-approximation files.

Vectors are approximated in blocks: one byte of cell number for each component, in equal-width
cells of the block's range. Tiles of blocks and sets of queries meet as cell numbers only; as
cells are of equal width, bounds of all scores of a tile are one matrix product. A vector whose
upper bound is below k lower bounds of its tile, and then below k of all tiles, is out. What is
left is read as exact vectors in order of its bounds: the k first of each query, then those
whose bound reaches the least exact score of these; no other can be among the k best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import columns, pack
from .shared import cut

#: Components in a block of vectors, in a tile of blocks and in a set of queries; queries bounded at a time.
VECTOR_BLOCK, TILE, QUERY_SET, STRIP = 1 << 19, 1 << 21, 1 << 18, 32
CELLS = 256
#: Scores are told within a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector):
    """The vector as doubles; null if it or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.when(vector.isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), doubles)


def is_wide(vector, factor: int):
    """Whether products of this vector could pass a long, even with another that isn't wide; such are counted with whole numbers of any size."""
    return F.exists(vector, lambda x: F.abs(x * factor) > F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1))) - 1)


def scaled(data: np.ndarray, factor: int, wide: bool) -> np.ndarray:
    """floor(factor * x) of each component; ``wide`` ones as Python's integers."""
    if not wide:
        return np.floor(data * factor).astype(np.int64)
    whole = lambda x: int(x) * factor if abs(x) >= 2.0**53 else math.floor(x * factor)
    return np.array([[whole(x) for x in row] for row in data.tolist()], object).reshape(data.shape)


class CellFile:
    """Cell numbers of a block of vectors, the first cells' borders and the cells' widths, as doubles."""

    def __init__(self, cell: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.cell, self.low, self.width = cell, low, width

    @classmethod
    def of(cls, exact: np.ndarray, cells: int = CELLS) -> CellFile:
        """From whole numbers held as doubles; at least one vector."""
        with np.errstate(all="ignore"):
            low = exact.min(axis=0)
            width = np.floor((exact.max(axis=0) - low) / cells) + 1
            cell = np.nan_to_num(np.floor((exact - low) / width), nan=0.0)
        return cls(np.clip(cell, 0, cells - 1).astype(np.uint8), low, width)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of each vector (row) with each query (column).

        They are let out by more than what doubles may lose; what passes all doubles bounds nothing.
        """
        with np.errstate(all="ignore"):
            inside = self.width - 1
            reach = np.maximum(np.abs(self.low), np.abs(self.low + CELLS * self.width))
            slack = np.abs(queries) @ reach * ((len(reach) + 16) * 2.0**-50)
            lower = self.cell.astype(np.float64) @ (queries * self.width).T + (queries @ self.low + np.minimum(queries, 0) @ inside - slack)
            upper = lower + (np.abs(queries) @ inside + 2 * slack)
        lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
        return np.clip(lower, LEAST, MOST), np.clip(upper, LEAST, MOST)


def first_copies(ids: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each distinct vector: others of it can't be among fewer best, by any query."""
    rows = np.ascontiguousarray(data).view(np.dtype((np.void, max(1, data.shape[1] * 8)))).ravel() if data.shape[1] else np.zeros(len(ids), np.int8)
    _, kind = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, kind.ravel()))
    sorted_kind = kind.ravel()[order]
    start = np.r_[0, np.flatnonzero(np.diff(sorted_kind)) + 1]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < most]


def possible(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, files: list[CellFile], k: int):
    """(query, vector, lower, upper) as arrays: what may be among the k best of these blocks, without vectors of the query's own id."""
    for at in range(0, len(queries), STRIP):
        both = [file.bounds(queries[at : at + STRIP]) for file in files]
        lower, upper = (np.concatenate(part) for part in zip(*both, strict=True))
        other = ids[:, None] != own[None, at : at + STRIP]
        lower[~other] = -np.inf
        kth = np.partition(lower, len(ids) - k, axis=0)[len(ids) - k] if len(ids) >= k else np.full(lower.shape[1], -np.inf)
        query, vector = np.nonzero(((upper >= kth) & other).T)
        yield query + at, vector, lower[vector, query], upper[vector, query]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024, vector_block: int = VECTOR_BLOCK, tile: int = TILE, query_set: int = QUERY_SET) -> DataFrame:
    """The k best-scoring vectors of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(factor * x); the score is the integer inner product; ties go to the
    smaller id. Vectors of the query's id are not its results. Null vectors, vectors with a null or
    non-finite component, and those with a null id take no part. Components of any finite size are counted exactly; a score
    beyond a long is told as the nearest long and ranks as that. Vectors of unlike length aren't compared. A repeated row of a vector is a
    candidate of its own; a repeated query row is one query. An empty table gives no rows. Other columns are not read.

    Exact vectors are moved to be gathered by row and to meet the candidates; with query sets only cell numbers are,
    a byte for each component. ``vector_block``, ``tile`` and ``query_set`` are numbers of components held together.
    """

    def ready(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
        return rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")).withColumns({"dim": F.size("v"), "wide": is_wide(F.col("v"), factor)})

    stored = cut(ready(vectors), "vectors")
    asked = cut(ready(queries).drop("n").withColumn("query", F.row_number().over(W.partitionBy("id").orderBy("v"))), "queries")
    sizes = [df.agg(F.sum(F.greatest(F.col("dim"), F.lit(1)).cast("long"))).first()[0] or 0 for df in (stored, asked)]
    n_tiles, n_sets = 1 + sizes[0] // tile, 1 + sizes[1] // query_set

    def approximate(batches):
        fields = [("tile", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.binary()), ("cell", pa.binary())]
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                ids, data = part["id"].to_numpy(zero_copy_only=False), np.array(part["v"].flatten(), np.float64).reshape(len(part), dim)
                kept = first_copies(ids, data, k + 1)
                step = max(1, vector_block // max(1, dim))
                for at in range(0, len(kept), step):
                    some = kept[at : at + step]
                    with np.errstate(all="ignore"):
                        file = CellFile.of(np.floor(data[some] * factor))
                    # the tile by the block's first id: a recomputed block goes where it went
                    rows = [((int(ids[some[0]]) * 0x9E3779B97F4A7C15 >> 32) % n_tiles, dim, pack(ids[some]), pack(file.low), pack(file.width), pack(file.cell))]
                    yield from columns(rows, fields).to_batches()

    def fill(table: pa.Table) -> pa.Table:
        fields = [("set", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("queries", pa.binary()), ("data", pa.binary())]
        data = np.array(table["v"].combine_chunks().flatten(), np.float64)
        return columns([(table["set"][0].as_py(), table["dim"][0].as_py(), pack(table["id"].to_numpy()), pack(table["query"].to_numpy()), pack(data))], fields)

    blocks = stored.select("id", "v", "dim").mapInArrow(approximate, "tile int, dim int, ids binary, low binary, width binary, cell binary")
    blocks = blocks.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
    sets = asked.select("id", "query", "v", "dim", F.pmod(F.xxhash64("id", "query"), F.lit(n_sets)).cast("int").alias("set"))
    sets = sets.groupBy("set", "dim").applyInArrow(fill, "set int, dim int, ids binary, queries binary, data binary")
    sets = sets.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [("query_id", pa.int64()), ("query", pa.int32()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())]
        tables = [columns([], fields)]
        if len(left) and len(right):
            dim = left["dim"][0].as_py()
            held = [(np.frombuffer(b["ids"], np.int64), CellFile(np.frombuffer(b["cell"], np.uint8).reshape(-1, dim), np.frombuffer(b["low"]), np.frombuffer(b["width"]))) for b in left.to_pylist()]
            ids, files = np.concatenate([i for i, _ in held]), [f for _, f in held]
            for b in right.to_pylist():
                own, query = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["queries"], np.int32)
                with np.errstate(all="ignore"):
                    data = np.floor(np.frombuffer(b["data"]).reshape(len(own), dim) * factor)
                for q, v, lower, upper in possible(data, own, ids, files, k):
                    tables.append(pa.table([own[q], query[q], ids[v], lower, upper], schema=pa.schema(fields)))
        return pa.concat_tables(tables)

    keys = ["tile", "set", "dim"]
    bounded = blocks.groupBy(*keys).cogroup(sets.groupBy(*keys)).applyInArrow(bound, "query_id long, query int, vec_id long, lower double, upper double")
    # equal ids with unlike vectors are read together
    bounded = bounded.groupBy("query_id", "query", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    each = W.partitionBy("query_id", "query")
    kth = F.nth_value("lower", k).over(each.orderBy(F.desc("lower")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    place = F.row_number().over(each.orderBy(F.desc("upper"), "vec_id"))
    near = cut(bounded.withColumn("kth", kth).where("kth is null or upper >= kth").withColumn("place", place).drop("lower", "kth"), "bounds")

    def score(batches):
        fields = [("query_id", pa.int64()), ("query", pa.int32()), ("vec_id", pa.int64()), ("n", pa.int64()), ("score", pa.int64())]
        for batch in batches:
            dims, wides = (batch[c].to_numpy(zero_copy_only=False) for c in ("dim", "wide"))
            for dim, wide in sorted(set(zip(dims.tolist(), wides.tolist(), strict=True))):
                part = batch.filter(pa.array((dims == dim) & (wides == wide)))
                x, y = (scaled(np.array(part[c].flatten(), np.float64).reshape(len(part), dim), factor, wide) for c in ("v", "query_v"))
                scores = [max(LEAST, min(MOST, s)) for s in (x * y).sum(axis=1).tolist()]
                yield pa.record_batch([part["query_id"], part["query"], part["vec_id"], part["n"], pa.array(scores, pa.int64())], schema=pa.schema(fields))

    exact = stored.select(F.col("id").alias("vec_id"), "v", "dim", "wide", "n")
    ask = asked.select(F.col("id").alias("query_id"), "query", F.col("v").alias("query_v"), "dim", F.col("wide").alias("query_wide"))

    def read(wanted: DataFrame) -> DataFrame:
        met = wanted.join(exact, "vec_id").join(ask, ["query_id", "query", "dim"])
        rows = met.select("query_id", "query", "vec_id", "n", "dim", (F.col("wide") | F.col("query_wide")).alias("wide"), "v", "query_v")
        return rows.mapInArrow(score, "query_id long, query int, vec_id long, n long, score long")

    first = cut(read(near.where(F.col("place") <= k)), "first")
    reached = first.groupBy("query_id", "query").agg(F.min("score").alias("reached"))
    # beside the k first there is another, so that k have been read
    rest = near.where(F.col("place") > k).join(reached, ["query_id", "query"]).where(F.col("upper") >= F.col("reached"))
    found = first.unionByName(read(rest.select("query_id", "query", "vec_id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
