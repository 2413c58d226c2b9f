"""Posting lists in files: each term's documents in delta-packed blocks, found again by reading the term's bucket alone.

A folder holds ``blocks`` (partitioned by bucket of the term, sorted by term and place) and ``terms`` (how many documents and blocks each
term has, and its place by frequency). A block has at most ``BLOCK`` documents of one stretch of ids, so a term that a third of
all documents hold is many rows, of many tasks, and a reader skips the stretches that the other terms of a query don't touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a block; bits of the ids within one stretch.
BLOCK, STRETCH_BITS = 1024, 16
#: Documents whose words of one bucket are one task's.
SHARE = 1 << STRETCH_BITS
BLOCKS = "term string, stretch bigint, first bigint, last bigint, n int, most int, ids binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, not negative, in seven bits a byte; the upper bit says that more follow."""
    rest, out, places = values.astype(np.uint64), [], []
    at = np.arange(len(rest))
    level = 0
    while len(at):
        more = rest >= 128
        out.append((rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7))
        places.append(at * 10 + level)
        at, rest, level = at[more], rest[more] >> np.uint64(7), level + 1
    order = np.argsort(np.concatenate(places), kind="stable") if out else []
    return np.concatenate(out)[order].tobytes() if out else b""


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((raw & 127).astype(np.uint64) << shift, starts).astype(np.int64)


def _blocks(batches):
    """Sorted (term, id, count) rows to blocks; what a batch leaves of its last term and stretch waits for the next batch."""
    kept: list[pa.RecordBatch] = []

    def blocks(table: pa.Table):
        terms = table["term"].combine_chunks().dictionary_encode()
        code, names = terms.indices.to_numpy(), terms.dictionary
        ids, counts = (table[c].to_numpy() for c in ("id", "count"))
        stretch = ids >> STRETCH_BITS
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])])
        sizes = np.diff(np.r_[new, len(ids)])
        starts = np.concatenate([np.arange(a, a + n, BLOCK) for a, n in zip(new.tolist(), sizes.tolist(), strict=True)])
        ends = np.r_[starts[1:], len(ids)]
        step = np.r_[0, np.diff(ids)]
        step[starts] = 0
        rows = [(code[a], stretch[a], ids[a], ids[b - 1], b - a, counts[a:b].max(), pack(step[a:b]), pack(counts[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.array(columns[0]))), *[pa.array(np.array(c, np.int64)) for c in columns[1:4]], *[pa.array(np.array(c, np.int32)) for c in columns[4:6]], *[pa.array(c, pa.binary()) for c in columns[6:]]],
            ["term", "stretch", "first", "last", "n", "most", "ids", "counts"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*kept, batch])
        stretch = table["id"].to_numpy() >> STRETCH_BITS
        # a stretch of one term has 2^STRETCH_BITS rows at most
        same = (stretch == stretch[-1]) & np.array(pc.equal(table["term"], table["term"][-1]))
        tail = 0 if same.all() else int(len(same) - np.argmin(same[::-1]))
        if tail:
            yield blocks(table.slice(0, tail))
        kept = table.slice(tail).to_batches()
    if kept:
        yield blocks(pa.Table.from_batches(kept))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, count): how often each word stands in each document; repeated rows of an id are one document. Null ids and texts have none."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)[\w가-힣]+"), F.lit(0))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(words).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("count"))


def shares(docs: DataFrame, id_col: str = "doc_id") -> int:
    """Tasks a bucket that ``write`` needs for these documents: one for each ``SHARE`` of them, so that tasks get no larger as documents get more."""
    return max(1, -(-docs.where(F.col(id_col).isNotNull()).count() // SHARE))


def write(counts: DataFrame, path: str, buckets: int = 64, tasks_a_bucket: int = 1) -> None:
    """Writes posting lists of (term, id, count).

    Words meet by bucket and stretch of ids, dealt to ``tasks_a_bucket`` tasks of each bucket (see ``shares``), and are packed as they come, sorted; no term is held whole.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    rows = counts.select("term", "id", "count", bucket.alias("bucket"), F.pmod(F.shiftright("id", STRETCH_BITS), F.lit(tasks_a_bucket)).alias("share"))
    rows = rows.repartition(buckets * tasks_a_bucket, "bucket", "share").sortWithinPartitions("term", "id").select("term", "id", "count")
    packed = rows.mapInArrow(_blocks, BLOCKS).withColumn("bucket", bucket)
    packed.write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = counts.sparkSession.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks")
    terms = blocks.groupBy("term", "bucket").agg(F.sum(F.col("n").cast("long")).alias("docs"), F.count(F.lit(1)).alias("blocks"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("most").alias("most"))
    terms.repartitionByRange(F.desc("docs"), "term").sortWithinPartitions(F.desc("docs"), "term").write.parquet(f"{path}/terms")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, bucket, docs, blocks, first, last, most) of all terms, most frequent first."""
    return spark.read.parquet(f"{path}/terms")


def blocks(spark: SparkSession, path: str, wanted: list[str], buckets: int = 64) -> DataFrame:
    """The blocks of some terms. Only their buckets are listed and read, and of these only the row groups that may hold the terms."""
    where = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in wanted]).first() if wanted else ()
    stored = spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks")
    return stored.where(F.col("bucket").isin(*{*where}) & F.col("term").isin(*wanted)) if wanted else stored.where("false")


def opened(packed: DataFrame) -> DataFrame:
    """(term, id, count) of blocks."""

    def each(batches):
        for batch in batches:
            ids, counts = ([unpack(x) for x in batch[c].to_pylist()] for c in ("ids", "counts"))
            if not ids:
                continue
            sizes = [len(x) for x in ids]
            every = np.concatenate([first + np.cumsum(x) for first, x in zip(batch["first"].to_numpy(), ids, strict=True)])
            yield pa.RecordBatch.from_arrays([batch["term"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(every), pa.array(np.concatenate(counts).astype(np.int32))], ["term", "id", "count"])

    return packed.select("term", "first", "ids", "counts").mapInArrow(each, "term string, id bigint, count int")


def holding_all(spark: SparkSession, path: str, wanted: list[str], buckets: int = 64) -> DataFrame:
    """(id, count): documents that hold all of the terms, and how often together.

    Stretches in which a term has no block are skipped before any block is opened. No terms, or one that isn't stored, give no rows.
    """
    wanted = sorted({t.lower() for t in wanted})
    found = blocks(spark, path, wanted, buckets)
    shared = found.groupBy("stretch").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len(wanted)).select("stretch")
    met = opened(found.join(shared, "stretch", "left_semi")).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("count").alias("count"))
    return met.where(F.col("terms") == len(wanted)).select("id", "count")


def by_frequency(spark: SparkSession, path: str) -> DataFrame:
    """``terms`` with ``rank``: 1 for the most frequent, ties by name. Ranks are counted by ranges of the order, not by one task."""
    from quarry.operators.ranking import running_sum

    rows = terms(spark, path).withColumn("one", F.lit(1))
    return running_sum(rows, [], "one", F.desc("docs"), F.asc("term"), out="rank").drop("one")
