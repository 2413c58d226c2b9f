"""Toxicity of texts by bags of subwords.

Byte n-grams of words, ends of words included, have vectors by hash; the vectors of a window
of words are averaged into a linear softmax of two classes. Vectors and softmax are fitted
together, by exact gradients over a bounded sample. A document is as toxic as its most
toxic window, and is fitted so: of a toxic text the windows that look worst are to be
told, of another text none may be. So an insult in a long text isn't averaged away, and a
spelling that was never seen is known by the pieces it shares with seen ones.

Since the average is linear, a fitted model is one number for each hashed subword; scoring a
text adds these up word by word and takes windows as differences of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut
from .words import slices, text_buffer

#: Bytes of the subwords; their hashed numbers; words of a window.
SHORTEST, LONGEST, BUCKETS, WINDOW = 3, 6, 1 << 20, 4
#: Bytes of texts, or of a very long text, that are looked at together; each takes some 150 bytes of memory.
PIECE = 1 << 19
_APART = np.zeros(256, bool)
_APART[[0x20, *range(0x09, 0x0E), *b".,;:!?\"()[]"]] = True


@dataclass
class Bags:
    """Subwords of a batch: the number and word of each; ``bounds[d]:bounds[d + 1]`` are the words of text d."""

    subword: np.ndarray
    word: np.ndarray
    bounds: np.ndarray


def bags(column) -> Bags:
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    where = np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))
    wide = np.full(len(data) + n + 1, 0x20, np.uint8)
    wide[where] = data
    apart = _APART[wide]
    wide[apart] = 0x20
    opens = ~apart & np.r_[True, apart[:-1]]
    word_at = np.cumsum(opens) - 1
    closed = np.cumsum(apart)
    before = np.r_[0, np.cumsum(opens)]
    bounds = before[offsets + np.arange(n + 1)]
    key = wide.astype(np.uint64)
    subwords, words = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for size in range(2, min(LONGEST, len(wide)) + 1):
        key = key[:-1] << np.uint64(8) | wide[size - 1 :]
        if size < SHORTEST:
            continue
        # no space but at its ends
        whole = np.flatnonzero(closed[size - 2 : len(wide) - 1] == closed[: len(wide) - size + 1])
        mixed = (key[whole] | np.uint64(size) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        subwords.append((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int32))
        words.append(word_at[whole + 1].astype(np.int32))
    return Bags(np.concatenate(subwords), np.concatenate(words), bounds)


@dataclass
class Model:
    """A fitted classifier: what each hashed subword adds to the odds, and where they start. Empty texts have the odds of no window."""

    weight: np.ndarray
    bias: float

    def odds(self, column) -> np.ndarray:
        """Log odds of each text's most toxic window; a text beyond ``PIECE`` bytes is read in pieces that share the words of a window."""
        data, offsets = text_buffer(column)
        if len(offsets) == 2 and len(data) > PIECE:
            parts = [data[a:b].tobytes() for a, b in pieces(data)]
            return np.array([max(self._odds(pa.array([part], pa.large_binary()))[0] for part in parts)])
        return self._odds(column)

    def _odds(self, column) -> np.ndarray:
        found = bags(column)
        n_words = int(found.bounds[-1])
        total = np.bincount(found.word, self.weight[found.subword], n_words)
        count = np.bincount(found.word, minlength=n_words)
        return self.bias + worst(total, count, found.bounds)[0]

    def scores(self, column) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(column), -500, 500)))


def pieces(data: np.ndarray, size: int | None = None) -> list[tuple[int, int]]:
    """Ranges of a text's bytes, of about ``size`` or one word, whose windows are together those of the text."""
    size, at, out = size or PIECE, 0, []
    while True:
        high = at + size
        # to the end of a word, and on until there is a whole window, or no more text
        while True:
            gap = np.flatnonzero(_APART[data[high : high + size]])
            if high < len(data) and not len(gap):
                high += size
                continue
            end = len(data) if high >= len(data) else high + int(gap[0])
            apart = _APART[data[at:end]]
            starts = np.flatnonzero(~apart & np.r_[True, apart[:-1]])
            if len(starts) >= WINDOW or end == len(data):
                break
            high = end + size
        if not out or len(starts) >= WINDOW:  # else all of its words were in the piece before
            out.append((at, end))
        if end == len(data):
            return out
        at += int(starts[-(WINDOW - 1)])


def worst(total: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the greatest average of a window of words, and the window's first and last word; no words: 0 and nothing.

    ``total`` and ``count`` are those of the words' subwords.
    """
    n = len(bounds) - 1
    best, low, high = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if not len(some):
        return best, low, high
    sums, counts = np.r_[0.0, np.cumsum(total)], np.r_[0, np.cumsum(count)]
    word = np.arange(len(total))
    end = np.minimum(word + WINDOW, np.repeat(bounds[1:], np.diff(bounds)))
    average = (sums[end] - sums[word]) / np.maximum(counts[end] - counts[word], 1)
    # a window that the text's end cuts short is inside another, but for a text shorter than one
    average[(end - word < WINDOW) & (word > np.repeat(bounds[:-1], np.diff(bounds)))] = -np.inf
    best[some] = np.maximum.reduceat(average, bounds[:-1][some])
    doc = np.repeat(np.arange(n), np.diff(bounds))
    at = np.flatnonzero(average == best[doc])
    first = at[np.r_[True, doc[at][1:] != doc[at][:-1]]]
    low[some], high[some] = first, end[first]
    return best, low, high


def train(texts: list[str], toxic: np.ndarray, size: int = 16, rounds: int = 100, rate: float = 0.5, seed: int = 5) -> Model:
    """Fits vectors and softmax together on whole texts (lower-cased) and their labels."""
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if len(texts) and toxic.all() else -20.0)
    spaced = [bytes(0x20 if _APART[b] else b for b in t.encode()).split() for t in texts]
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(w, len(known)) for ws in spaced for w in ws], np.int64)
    bounds = np.r_[0, np.cumsum([len(ws) for ws in spaced])].astype(np.int64)
    own = bags(pa.array(list(known), pa.binary()))
    number, subword = np.unique(own.subword, return_inverse=True)
    count = np.bincount(own.word, minlength=len(known))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(number), size))
    softmax = rng.normal(0, 0.5, (size, 2))
    bias = np.zeros(2)
    past = [np.full(x.shape, 1e-8) for x in (vectors, softmax, bias)]
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())  # both classes weigh alike
    every = np.diff(bounds)
    for step in range(rounds):
        line = softmax[:, 1] - softmax[:, 0]
        total = np.bincount(own.word, (vectors @ line)[subword], len(known))
        if step < rounds // 6:  # nothing is known yet: all words of a text are its window
            low, high = bounds[:-1], bounds[1:]
        else:
            _, low, high = worst(total[word], count[word], bounds)
        sums, counts = np.r_[0.0, np.cumsum(total[word])], np.r_[0, np.cumsum(count[word])]
        n = np.maximum(counts[high] - counts[low], 1)
        odds = (sums[high] - sums[low]) / n + bias[1] - bias[0]
        slope = share * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - toxic)
        # of each word, then of each subword: what a unit more of it adds to the loss's odds
        edge = np.zeros(len(word) + 1)
        np.add.at(edge, low, slope / n)
        np.add.at(edge, high, -slope / n)
        by_word = np.bincount(word, np.cumsum(edge)[:-1], len(known))
        pull = np.bincount(subword, by_word[own.word], len(number))
        moved = (pull @ vectors)[:, None] * np.array([-1.0, 1.0])
        for value, slant, seen in zip((vectors, softmax, bias), (pull[:, None] * line, moved, slope.sum() * np.array([-1.0, 1.0])), past, strict=True):
            seen += slant**2
            value -= rate * slant / np.sqrt(seen)
    weight = np.zeros(BUCKETS, np.float32)
    weight[number] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bytes_per_class: int = 1 << 20, seed: int = 13, **options) -> Model:
    """Fits on a bounded sample of the documents that have a label.

    Of each label (0 and 1; others and null are left out) the distinct texts of smallest hashes are drawn, as long as they have
    ``bytes_per_class`` bytes together; texts of more than a sixteenth of that aren't drawn, whole texts are. Null and blank texts teach
    nothing, copies count once. Without rows of both labels every text has the score of the one there is, and 0 without any.
    Ids, lengths and hashes are shuffled, texts never; only drawn texts come to the driver.
    """
    key, none = F.col(id_col).alias("id"), Model(np.zeros(BUCKETS, np.float32), -20.0)
    low = F.lower(F.col(text_col))
    texts = docs.select(key, low.alias("text"), F.xxhash64(F.lit(seed), low).alias("h")).where((F.octet_length("text") <= bytes_per_class // 16) & (F.trim("text") != ""))
    known = labels.select(key, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    sizes = texts.select("id", "h", F.octet_length("text").cast("long").alias("b")).join(known, "id").groupBy("label", "h").agg(F.max("b").alias("b"))
    sizes = cut(sizes, "sizes")
    whole = {r["label"]: r["b"] for r in sizes.groupBy("label").agg(F.sum("b").alias("b")).collect()}
    if not whole:
        return none
    # of the smallest hashes twice as many bytes as wanted are expected; only those are put in order
    share = F.create_map(*[F.lit(x) for label, b in whole.items() for x in (label, min(1.0, 2.0 * bytes_per_class / b))])
    few = sizes.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share[F.col("label")])
    upto = F.sum("b").over(W.partitionBy("label").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    drawn = few.withColumn("upto", upto).where(F.col("upto") <= bytes_per_class).select("label", "h").collect()
    if not drawn:
        return none
    # at most a row for each byte of the sample
    wanted = docs.sparkSession.createDataFrame(sorted({(r["h"],) for r in drawn}), "h long")
    found = texts.where(F.col("h") <= max(r["h"] for r in drawn)).join(F.broadcast(wanted), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")).collect()
    of = {r["h"]: r["text"] for r in found}
    taught = sorted((r["label"], r["h"]) for r in drawn)
    return train([of[h] for _, h in taught], np.array([label == 1 for label, _ in taught], bool), **options)


def classify(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds the probability that a text is toxic and whether it is at least a half.

    Null, empty and blank texts have the score of no window, below a half where both labels were learned. Rows are judged alone, so repeated ones
    are alike; an empty table gives no rows. Of a very long text every window counts; it is read in pieces, so only its longest word bounds the memory it takes.
    All columns stay; one named like an added one is replaced.
    """
    df = df.drop(score_col, predicted_col)
    lower = "lower-cased text"
    schema = df.withColumns({score_col: F.lit(0.0), predicted_col: F.lit(0)}).schema
    names = [*df.columns, score_col, predicted_col]
    shipped = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever was learned

    def score(batches):
        for batch in batches:
            texts = batch.column(lower)
            found = [shipped.value.scores(texts.slice(low, high - low)) for low, high in slices(texts, PIECE)]
            scores = np.concatenate(found) if found else np.zeros(0)
            arrays = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != lower]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names)

    return df.withColumn(lower, F.lower(F.col(text_col))).mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row may not be learned from: crc32 of the id as text is a multiple of 5. A null id is not held out, but has no label either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
