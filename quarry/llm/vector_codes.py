"""Product codes of vectors, whose nearest entries are found by partial distances.

Vectors are cut into equal parts and each part position has a codebook of a few integer
entries. An assignment takes the dimensions of a codebook in descending variance: after each
one, entries whose squared distance so far is strictly greater than the best complete distance of
the row leave the search by a mask, so most entries are left after a dimension or two and
equal ones stay for the tie to be told. Codebooks are small (entries x dimensions of a
vector), so they go with the task; sums over all rows come back as whole numbers of any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_topk import is_wide, scaled, usable
from .shared import cut

#: Entries that are compared before the best complete distance is looked at again, and rows at a time.
STRIP, ROWS = 16, 1 << 13
LIMB = 40


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and squared distance of each row; whole numbers, held as longs or as Python's."""
    spread = np.nan_to_num(book.astype(np.float64), posinf=1e150, neginf=-1e150).clip(-1e150, 1e150).var(axis=0)
    order = np.argsort(-spread, kind="stable")
    first = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    index = first.argmin(1)
    best = ((x - book[index]) ** 2).sum(1)  # one complete distance, to measure the others by
    for at in range(0, len(book), STRIP):
        part = first[:, at : at + STRIP]
        row, entry = np.nonzero(part <= best[:, None])
        so_far, entry = part[row, entry], entry + at
        for d in order[1:]:
            so_far = so_far + (x[row, d] - book[entry, d]) ** 2
            near = (so_far <= best[row]).astype(bool)
            row, entry, so_far = row[near], entry[near], so_far[near]
        if not len(row):
            continue
        # rows are in order, and entries within them: of equal distances the first is the lowest
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(so_far, starts)
        tied = np.flatnonzero((so_far == np.repeat(least, np.diff(np.r_[starts, len(row)]))).astype(bool))
        tied = tied[np.r_[True, row[tied][1:] != row[tied][:-1]]]
        rows, found = row[tied], entry[tied]
        better = ((so_far[tied] < best[rows]) | (found < index[rows])).astype(bool)
        index[rows[better]], best[rows[better]] = found[better], so_far[tied][better]
    return index, best


class Codebooks:
    """Entries of each part position: an array (part, entry, position) of whole numbers."""

    def __init__(self, entries: np.ndarray, factor: int):
        self.entries, self.factor = entries, factor
        self.wide = bool(entries.size) and max(abs(int(entries.max())), abs(int(entries.min()))) >= 1 << 26
        if not self.wide:
            self.entries = entries.astype(np.int64)

    def blocks(self, batch):
        """(rows of the batch, whole numbers (row, part, position), indexes (row, part), distances (row, part))."""
        parts, _, width = self.entries.shape
        wides = batch["wide"].to_numpy(zero_copy_only=False)
        for wide in (False, True):
            rows = np.flatnonzero(wides == wide)
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                data = np.array(batch["v"].take(pa.array(some)).flatten(), np.float64).reshape(len(some), -1)
                whole = scaled(data, self.factor, wide).reshape(len(some), parts, width)
                books = self.entries.astype(object) if wide else self.entries
                kind = object if wide or self.wide else np.int64
                index, distance = np.empty((len(some), parts), np.int64), np.empty((len(some), parts), kind)
                for p in range(parts):
                    x = whole[:, p].astype(object) if self.wide else whole[:, p]
                    index[:, p], distance[:, p] = nearest(x, books[p])
                yield some, whole, index, distance

    def sums(self, batches):
        """(part, entry, position, limb, total): rows' sums by nearest entry, in limbs; position -1 counts them."""
        parts, entries, width = self.entries.shape
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, whole, index, _ in self.blocks(batch):
                for p in range(parts):
                    own = np.zeros((entries, width), whole.dtype)
                    np.add.at(own, index[:, p], whole[:, p])
                    total[p] += own.astype(object)
                    count[p] += np.bincount(index[:, p], minlength=entries)
        out = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count), strict=True)]
        for p, e in zip(*np.nonzero(count), strict=True):
            for k, value in enumerate(total[p, e].tolist()):
                sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
                while left:
                    out.append((p, e, k, limb, sign * (left & ((1 << LIMB) - 1))))
                    left, limb = left >> LIMB, limb + 1
        kinds = [("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in out], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    def moved(self, rows: DataFrame) -> Codebooks:
        """After a round: each entry the floor of its rows' mean, unused ones as they were."""
        found = rows.mapInArrow(self.sums, "part int, entry int, position int, limb int, total bigint").groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect()
        entries = self.entries.astype(object)
        count = {(r["part"], r["entry"]): r["total"] for r in found if r["position"] < 0}
        sums = np.zeros(entries.shape, object)
        for r in found:
            if r["position"] >= 0:
                sums[r["part"], r["entry"], r["position"]] += r["total"] << (LIMB * r["limb"]) if r["total"] >= 0 else -(-r["total"] << (LIMB * r["limb"]))
        for (p, e), n in count.items():
            entries[p, e] = sums[p, e] // n
        return Codebooks(entries, self.factor)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, factor: int) -> Codebooks | None:
    """Codebooks of rows (id, v, wide) of one length: from the smallest ids, moved by all rows in each round; none without rows."""
    # two small reads by id: of one id that comes more than once the least vector is taken
    ids = [r["id"] for r in vectors.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    first = vectors.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if ids else []
    if not first:
        return None
    data = np.array([r["v"] for r in first], np.float64)
    whole = scaled(data, factor, True).reshape(len(first), parts, -1)
    books = Codebooks(whole.transpose(1, 0, 2), factor)
    for _ in range(rounds):
        books = books.moved(vectors)
    return books


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(id_col, label_col, code, error) of every usable vector, and the codebooks.

    Components become floor(factor * x). A codebook starts as its part of the vectors of the ``entries`` (256 at most)
    smallest ids and is moved ``rounds`` times by all rows. ``code`` has two hex digits a part, ``error`` is the squared distance to the entries, summed.

    Null vectors and vectors with a null or non-finite component are left out. Vectors have the length of that of smallest id whose length is a
    multiple of ``parts``; those of another length have null code and error. A repeated row is a row of its own and weighs as much; of
    a repeated id the least vector starts an entry. A null id starts none. Finite components of any size are counted exactly, and an
    error beyond a long is told as the largest long. An empty table gives no rows and no codebooks. Other columns are not read.
    No row is shuffled; codebooks (``entries`` vectors) pass through the driver.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), usable(F.col(vector_col)).alias("v")).where("v is not null")
    fits = (F.size("v") > 0) & (F.size("v") % parts == 0)
    one = rows.where(fits & F.col("id").isNotNull()).orderBy("id", "v").select(F.size("v").alias("n")).first()
    length = one["n"] if one else -1
    # narrow enough that squared distances of whole vectors stay within a long
    fitting = rows.where(F.size("v") == length).withColumn("wide", is_wide(F.col("v"), 8 * factor))
    books = fit_codebooks(fitting, parts, entries, rounds, factor)
    schema = rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    other = rows.where(F.size("v") != length).select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        return other, None
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def assign(batches):
        for batch in batches:
            code, error = np.empty(len(batch), object), np.zeros(len(batch), object)
            for some, _, index, distance in books.blocks(batch):
                code[some] = ["".join(r) for r in hexes[index].tolist()]
                error[some] = [min(e, (1 << 63) - 1) for e in distance.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], [id_col, label_col, "code", "error"])

    return fitting.mapInArrow(assign, schema).unionByName(other), books


def errors_by_label(codes: DataFrame, label_col: str = "label", out_col: str = "label_error") -> DataFrame:
    """Adds the sum of ``error`` over equal labels (nulls are one label); beyond a long it is the largest long.

    Rows stay where they are unless there are too many labels to send along; then a label of very many rows is split by adaptive execution.
    """
    codes = cut(codes, "codes")
    total = F.sum(F.coalesce("error", F.lit(0)).cast("decimal(38,0)"))
    sums = cut(codes.groupBy(F.col(label_col).alias("of")).agg(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias(out_col)), "labels")
    return codes.join(sums, F.col(label_col).eqNullSafe(F.col("of")), "left").drop("of")
