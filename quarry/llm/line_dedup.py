"""Line dedup by a deletion-neighbourhood join.

Equal lines are brought together first. Two unlike lines within one edit agree in their
first or their last half, and in a half of the other half, so lines that share none of these
with any other are done. The others emit, as hashed keys, every variant with one
character of the quarter that is left deleted (and themselves). Lines that meet in a key are
compared exactly; the earliest stays. Short lines, whose halves and quarters would tell little
or nothing, all emit their variants: of one with n characters there are 2 n + 1 at most.

A key holds the place of the deletion where both lines lose a character (then they differ
there only), so every two lines of a group are within one edit, and comparing each with the
group's earliest is enough. As equal lines were brought together, a group has at most one
line for each character that can stand at that place: no group grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut
from .words import mix

#: White space that is cut from both ends of a line.
BLANKS = " \t\r\v\f"
_LAST = (1 << 63) - 1
#: Lines are grouped by length into steps of so many characters; shared ends are half as long.
STEP = 8
#: Lines up to this length meet by all their variants, lines from this length on by shared ends: any two within one edit are on one side together.
SHORT = 20


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows with their place in the order of documents and a digest that tells unlike rows of one id apart."""
    return docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"),
        F.xxhash64(text_col).alias("sig"), F.col(text_col).cast("string").alias("text"),
    )


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    parts = rows.select("key", "sig", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return parts.withColumn("line", F.trim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)


def _half(as_length):
    """The size of a line's shared end, as if it had ``as_length`` characters."""
    return F.floor(as_length / STEP).cast("int") * (STEP // 2)


def _ends(length) -> list:
    """The hashed first and last half of a line; at a border of lengths also as a line of one less, to meet such lines."""
    out = []
    for as_length, counts in ((length, None), (length - 1, length % STEP == 0)):
        half = _half(as_length)
        for side, end in ((0, F.left), (1, F.right)):
            key = F.xxhash64(F.lit(side), half, end(F.col("line"), half))
            out.append(key if counts is None else F.when(counts, key))
    return out


def _power_table(n: int, base: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def variants(line: str, salt: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line whose edit, if any, is at ``low`` to ``high``: itself (0), shortened (1), shortened at a known place (2).

    Keys are sums of characters times powers of an odd base, so a deletion shifts what follows by one power.
    """
    code = mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    n = len(code)
    power = _power_table(n, _BASE)
    total = np.r_[np.uint64(0), np.cumsum(code * power[:n], dtype=np.uint64)]
    at = np.arange(low, high)
    short = total[at] + (total[n] - total[at + 1]) * np.uint64(_UNBASE)
    salt = np.uint64(salt & ((1 << 64) - 1))
    anew = at[(at == at[0]) | (code[at] != code[at - 1])] - at[0] if len(at) else at  # in a run of one character every deletion is the same
    whole = mix(mix(total[n : n + 1] ^ salt) + np.uint64(n))
    shorter = mix(mix(short[anew] ^ salt) + np.uint64(n - 1))
    placed = mix(mix(short ^ salt) + np.uint64(n)) ^ mix((at + 1).astype(np.uint64) << np.uint64(32))
    return np.concatenate([whole, shorter, placed]), np.repeat(np.array([0, 1, 2], np.int8), [1, len(anew), len(placed)])


def _emit(batches):
    for batch in batches:
        keys, kinds, who = [], [], []
        size = 0
        for row in batch.to_pylist():
            key, kind = variants(row["line"], row["salt"], row["low"], row["high"])
            keys.append(key.view(np.int64))
            kinds.append(kind)
            who.append(np.full(len(key), row["h1"], np.int64))
            size += len(key)
            if size > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, kinds, who)], ["k", "kind", "h1"])
                keys, kinds, who, size = [], [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, kinds, who)], ["k", "kind", "h1"])


#: Bits of the filters that spare rows a shuffle: 4 MiB, whatever the input. Fuller ones spare less and are as exact.
FILTER_BITS = 1 << 25


def _filter(hashes: DataFrame) -> DataFrame:
    """(part, bits) of a set of hashes ``h``: a bit for each remainder by ``FILTER_BITS``, 1024 rows of 4 KiB at most."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    return hashes.select(F.floor(at / 32768).cast("int").alias("part"), (at % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _tested(rows: DataFrame, h, filter_: DataFrame) -> DataFrame:
    """Rows with ``maybe``: false only if their hash isn't in the filter's set."""
    at = F.pmod(h, F.lit(FILTER_BITS))
    placed = rows.withColumns({"part": F.floor(at / 32768).cast("int"), "bit": (at % 32768).cast("int")})
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(filter_), "part", "left")
    return found.withColumn("maybe", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False))).drop("part", "bit", "bits")


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Rows whose key another line has as well. Keys are counted before they are shuffled, and no group is gathered."""
    met = keyed.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(key)
    return keyed.join(met, key)


def _quarters(lines: DataFrame) -> DataFrame:
    """(h1, line, salt, low, high): under each shared end, the two halves of the rest that may be alike, and where the edit is then."""
    rows = lines.withColumns({"n": F.char_length("line"), "q": (F.col("half") / 2).cast("int")})
    first = F.col("side") == 0
    near = F.when(first, F.substr("line", F.col("half") + 1, F.col("q"))).otherwise(F.substr("line", F.col("n") - F.col("half") - F.col("q") + 1, F.col("q")))
    far = F.when(first, F.right("line", F.col("q"))).otherwise(F.left("line", F.col("q")))
    part = lambda k, text, low, high: F.struct(F.xxhash64("end", F.lit(k), text).alias("salt"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    parts = F.array(
        part(0, near, F.when(first, F.col("half") + F.col("q")).otherwise(0), F.when(first, F.col("n")).otherwise(F.col("n") - F.col("half") - F.col("q"))),
        part(1, far, F.when(first, F.col("half")).otherwise(F.col("q")), F.when(first, F.col("n") - F.col("q")).otherwise(F.col("n") - F.col("half"))),
    )
    return rows.select("h1", "line", F.explode(parts).alias("p")).select("h1", "line", "p.*")


def _near(lines_of: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, near): for lines with an unlike earlier line within one edit, the earliest such place."""
    ends = distinct.select("h1", F.posexplode("ends").alias("k", "end")).where("end is not null")
    sharing = _shared(ends, "end").groupBy("h1").agg(F.collect_list(F.struct("k", "end")).alias("e"))  # 4 at most
    sharing = cut(sharing.join(distinct.select("h1", "h2", "first"), "h1"), "line-ends")
    found = _tested(lines_of.withColumn("h1", F.xxhash64("line")), F.col("h1"), _filter(sharing.select(F.col("h1").alias("h")))).where("maybe")
    found = found.select("h1", F.struct("key", "pos", "sig").alias("first"), "line")
    lines = cut(sharing.join(found, ["h1", "first"]), "line-texts")

    length = F.char_length("line")
    each = lines.select("h1", "line", F.explode("e").alias("e")).select("h1", "line", "e.end", (F.col("e.k") % 2).alias("side"), _half(length - F.floor(F.col("e.k") / 2)).alias("half"))
    short = distinct.where("short is not null").select("h1", "h2", "first", F.col("short").alias("line"))
    whole = short.select("h1", "line", F.lit(0).cast("long").alias("salt"), F.lit(0).alias("low"), length.cast("int").alias("high"))
    quarters = _shared(_quarters(each), "salt").select("h1", "line", "salt", "low", "high").unionByName(whole)
    lines = lines.select("h1", "h2", "first", "line").where(length > SHORT).unionByName(short)
    # A line itself and shortened lines that equal it meet in one key; so do lines short of the same place.
    group = W.partitionBy("k")
    emitted = quarters.mapInArrow(_emit, "k long, kind byte, h1 long")
    joined = emitted.withColumns({"a": F.min("h1").over(group), "b": F.max("h1").over(group)}).where("a <> b").select("k", "kind", "h1")
    joined = joined.join(lines, "h1").withColumn("me", F.struct("first.key", "first.pos", "line"))
    own = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("me"))).over(group)
    other = F.when(F.col("kind") == 0, own(1)).when(F.col("kind") == 1, own(0)).otherwise(own(2))
    pairs = joined.withColumn("other", other).where("other.key < me.key or other.key = me.key and other.pos < me.pos")
    verified = pairs.where(F.levenshtein("me.line", "other.line", 1) == 1)
    return verified.groupBy("h1", "h2").agg(F.min(F.struct("other.key", "other.pos")).alias("near"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, lines_col: str = "n_lines", removed_col: str = "n_lines_removed", kept_col: str = "kept_text") -> DataFrame:
    """Removes every line that stands within one edit of an earlier line, in its own or another document.

    Lines are what newlines part, without blanks at their ends; an edit inserts, deletes or replaces one
    character (code point). Earlier is by id, then by place in the text. Every line that isn't blank is judged,
    whatever its length (of two lines of one character the later goes); with a greater ``min_chars``, lines of
    fewer characters neither go nor make others go. Lines are judged on the input, not on what is left: with A, B,
    C each one edit from the one before, B and C go.

    Adds ``lines_col`` (lines of the text), ``removed_col`` and ``kept_col`` (what is left, joined by newlines;
    lines that stay are unchanged). All columns stay; those named like an added one are replaced.

    Null text: no lines, kept null. Empty text: one empty line, kept. A null id comes last; rows of one id that
    hold the same line at the same place leave each other alone (repeated rows have the same result).
    """
    docs = docs.drop(lines_col, removed_col, kept_col)
    rows = _rows(docs, id_col, text_col)
    lines = _lines(rows, min_chars)
    length = F.char_length("line").cast("int")
    hashed = lines.select("key", "sig", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.when(length >= SHORT, F.array(*_ends(length))).alias("ends"), F.when(length <= SHORT, F.col("line")).alias("short"))
    distinct = cut(hashed.groupBy("h1", "h2", "ends", "short").agg(F.min(F.struct("key", "pos", "sig")).alias("first"), F.count(F.lit(1)).alias("copies")), "lines")
    repeated = distinct.where("copies > 1").select("h1", "h2", F.struct(F.col("first.key").alias("key"), F.col("first.pos").alias("pos")).alias("stays"))
    judged = cut(repeated.unionByName(_near(lines, distinct).withColumnRenamed("near", "stays")).groupBy("h1", "h2").agg(F.min("stays").alias("stays")), "lines-judged")
    placed = _tested(hashed.select("key", "sig", "pos", "h1", "h2"), F.col("h1"), _filter(judged.select(F.col("h1").alias("h")))).where("maybe").drop("maybe")
    gone = placed.join(judged, ["h1", "h2"]).where("key > stays.key or key = stays.key and pos > stays.pos")
    gone = cut(gone.groupBy("key", "sig").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    digest = F.xxhash64("key", "sig")
    whole = _tested(rows.select("row", "key", "sig"), digest, _filter(gone.select(digest.alias("h"))))
    changed = whole.where("maybe").join(gone, ["key", "sig"], "left").select("row", "gone")
    out = changed.unionByName(whole.where("not maybe").select("row", F.lit(None).cast("array<int>").alias("gone")))
    return _without(out.select("row.*", F.col("gone").alias("gone ")), text_col, "gone ", lines_col, removed_col, kept_col)


def _without(df: DataFrame, text_col: str, gone_col: str, lines_col: str, removed_col: str, kept_col: str) -> DataFrame:
    kept = df.drop(gone_col)
    schema = kept.withColumns({lines_col: F.lit(0).cast("long"), removed_col: F.lit(0).cast("long"), kept_col: F.lit(None).cast("string")}).schema

    def take(batches):
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, gone in zip(batch.column(text_col), batch.column(gone_col), strict=True):
                parts = text.as_py().split("\n") if text.is_valid else []
                out = set(gone.as_py() or ())
                counts.append(len(parts))
                removed.append(len(out))
                texts.append("\n".join([p for i, p in enumerate(parts) if i not in out]) if text.is_valid else None)
            names = [n for n in batch.schema.names if n != gone_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], [*names, lines_col, removed_col, kept_col])

    return df.mapInArrow(take, schema)
