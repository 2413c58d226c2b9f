"""Language identification by prediction by partial matching over bytes.

For each language a tree of contexts of up to ``order`` bytes counts what followed.
A byte costs what its longest known context says; a context that never saw it costs
an escape (method C: as many escapes as distinct followers) and hands on to the next
shorter one, down to a uniform byte. Counts are frozen after fitting, so a byte's cost
hangs on the last ``order + 1`` bytes alone and is tabulated; scoring a text is looking
up its byte n-grams and adding. The language of the shortest code wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut
from .words import slices, text_buffer

UNKNOWN = "und"
#: A text is read as if this many spaces stood before it.
_PAD = b"        "
#: Languages of one model, and bytes of models that are sent to a worker at once.
TOGETHER, MOST_BYTES = 8, 256 << 20
_LETTER = re.compile(r"[A-Za-z]")


def letters(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


class Grams:
    """A fixed hash table from byte n-grams (as integers) to rows."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.slot = np.full(size, -1, np.int32)
        self.key = np.zeros(size, np.uint64)
        left, at, self.probes = np.arange(len(keys)), self._home(keys), 0
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several that want a slot the last one stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
            self.probes += 1
        taken = self.slot >= 0
        self.key[taken] = keys[self.slot[taken]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._home(keys)
        row = self.slot[at]
        open_ = np.flatnonzero((row >= 0) & (self.key[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slot) - 1)
            row[open_] = self.slot[at]
            again = (self.slot[at] >= 0) & (self.key[at] != keys[open_])
            open_, at = open_[again], at[again]
        return row


@dataclass
class Model:
    """Frozen costs in bits. ``costs[k]`` and ``escapes[k]`` belong to contexts of k bytes."""

    languages: list[str]
    order: int
    grams: list[Grams]
    costs: list[np.ndarray]
    contexts: list[Grams]
    escapes: list[np.ndarray]

    def bits(self, column) -> np.ndarray:
        """Code length of each text under each language."""
        data, offsets = text_buffer(column)
        n, pad = len(offsets) - 1, self.order
        if not self.languages or not n:
            return np.zeros((n, len(self.languages)))
        where = np.arange(len(data)) + pad * (1 + np.repeat(np.arange(n), np.diff(offsets)))
        wide = np.full(len(data) + pad * n, 0x20, np.uint64)
        wide[where] = data
        gram = wide[where]
        for k in range(1, pad + 1):
            gram |= wide[where - k] << np.uint64(8 * k)
        cost = self._cost(gram, self.order)
        total = np.zeros((n, len(self.languages)))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if len(filled):
            total[filled] = np.add.reduceat(cost, offsets[filled], axis=0, dtype=np.float64)
        return total

    def _cost(self, gram: np.ndarray, order: int) -> np.ndarray:
        row = self.grams[order].find(gram)
        cost = self.costs[order][row]
        missed = np.flatnonzero(row < 0)
        if len(missed):
            left = gram[missed]
            if order:
                row = self.contexts[order].find(left >> np.uint64(8))
                escape = np.where((row >= 0)[:, None], self.escapes[order][row], np.float32(0))
                cost[missed] = escape + self._cost(left & np.uint64((1 << 8 * order) - 1), order - 1)
            else:
                cost[missed] = self.escapes[0][0] + np.float32(8)
        return cost

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.costs, *self.escapes)) + sum(g.slot.nbytes + g.key.nbytes for g in (*self.grams, *self.contexts))


@dataclass
class Models:
    """Trees of all languages, a few in each model: n-grams that no language of a model knows take no room in it."""

    parts: list[Model]

    @property
    def languages(self) -> list[str]:
        return [name for part in self.parts for name in part.languages]

    @property
    def nbytes(self) -> int:
        return sum(part.nbytes for part in self.parts)

    def bits(self, column) -> np.ndarray:
        """Code length of each text under each language, some texts and one model at a time."""
        found = [np.zeros((0, len(self.languages)))]
        for low, high in slices(column, 1 << 20):
            found.append(np.hstack([part.bits(column.slice(low, high - low)) for part in self.parts] or [np.zeros((high - low, 0))]))
        return np.concatenate(found)

    def groups(self, most: int) -> list[Models]:
        """The models in their order, in groups of ``most`` bytes or of one model."""
        out: list[Models] = []
        for part in self.parts:
            if not out or out[-1].nbytes + part.nbytes > most:
                out.append(Models([]))
            out[-1].parts.append(part)
        return out


def judged(languages: list[str], texts: pa.Array, bits: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, probability and bits a byte for each text, from its code lengths."""
    names, scores, rates = [], [], []
    for text, row in zip(texts.to_pylist(), bits, strict=True):
        if not languages or text is None or not letters(text):
            names.append(UNKNOWN)
            scores.append(0.0)
            rates.append(None)
            continue
        best = int(row.argmin())
        names.append(languages[best])
        scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
        rates.append(float(row[best] / len(text.encode())))
    return names, scores, rates


def build(languages: list[str], order: int, counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from each language's counts of (order + 1)-grams."""
    grams, costs, contexts, escapes = [], [], [], []
    n = len(languages)
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = []
        for keys, count in counts:
            short, back = np.unique(keys & mask, return_inverse=True)
            own.append((short, np.bincount(back, count, len(short))))
        known = np.unique(np.concatenate([s for s, _ in own])) if n else np.empty(0, np.uint64)
        context = np.unique(known >> np.uint64(8)) if k else np.zeros(1, np.uint64)
        seen = np.zeros((len(known), n))
        for i, (short, count) in enumerate(own):
            seen[np.searchsorted(known, short), i] = count
        of = np.searchsorted(context, known >> np.uint64(8)) if k else np.zeros(len(known), np.int64)
        total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0).astype(np.float32)
            cost = np.log2((total + kinds)[of] / seen)
        lower = costs[k - 1][grams[k - 1].find(known & np.uint64((1 << 8 * k) - 1))] if k else np.full((len(known), n), 8, np.float32)
        costs.append(np.where(seen > 0, cost, escape[of] + lower).astype(np.float32))
        grams.append(Grams(known))
        contexts.append(Grams(context))
        escapes.append(escape)
    return Model(languages, order, grams, costs, contexts, escapes)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 3, bytes_per_language: int = 4 << 20, seed: int = 11) -> Models:
    """Fits the trees on a bounded sample of labelled rows.

    Of each language the distinct texts of smallest hashes are drawn, as long as they have ``bytes_per_language`` bytes
    together, and always the first. A text longer than a sixteenth of that gives a piece of so many characters, from a
    place drawn by its hash. So no language is left out, whatever its copies or its longest text, and the sample has at most
    ``bytes_per_language`` bytes for each language (or a quarter of that and one text's piece). Copies count once. Rows whose
    text or language is null and empty texts are left out. Languages may be of any number: their counts come to the driver for ``TOGETHER`` languages at a
    time, and what is kept of them grows with their number, not with its square.
    """
    piece = max(1, bytes_per_language // 16)
    most = max(1, bytes_per_language // 64)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    long = F.char_length("text") > piece
    at = F.pmod(F.col("h"), F.char_length("text") - piece + 1).cast("int") + 1
    rows = rows.select("lang", "h", F.when(long, F.substr("text", at, F.lit(piece))).otherwise(F.col("text")).alias("text"))
    sizes = cut(rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("b")), "languages")
    whole = sizes.groupBy("lang").agg(F.sum("b").alias("b"), F.min("h").alias("h")).collect()
    if not whole:
        return Models([])
    # of the smallest hashes, twice as many bytes as wanted are expected; only those are put in order
    share = F.create_map(*[F.lit(x) for r in whole for x in (r["lang"], min(1.0, 2.0 * bytes_per_language / r["b"]))])
    few = sizes.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")])
    by_hash = W.partitionBy("lang").orderBy("h")
    first = few.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= most)
    taken = first.withColumn("total", F.sum("b").over(by_hash.rowsBetween(W.unboundedPreceding, 0))).where(F.col("total") <= bytes_per_language)
    limits = {r["lang"]: r["h"] for r in whole} | {r["lang"]: r["limit"] for r in taken.groupBy("lang").agg(F.max("h").alias("limit")).collect()}
    limit = F.create_map(*[F.lit(x) for x in (z for pair in limits.items() for z in pair)])
    drawn = rows.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                texts = batch.column("text").filter(pa.array(langs == lang))
                found: dict[int, int] = {}
                for low, high in slices(texts):
                    data, offsets = text_buffer(texts.slice(low, high - low))
                    wide = np.frombuffer(b"".join(_PAD[:order] + data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint8).astype(np.uint64)
                    gram = wide[order:].copy()
                    for k in range(1, order + 1):
                        gram |= wide[order - k : -k] << np.uint64(8 * k)
                    inner = np.ones(len(gram), bool)
                    ends = np.cumsum(np.diff(offsets) + order)[:-1]
                    for k in range(order):
                        inner[ends - order + k] = False
                    keys, n = np.unique(gram[inner], return_counts=True)
                    for key, c in zip(keys.tolist(), n.tolist(), strict=True):
                        found[key] = found.get(key, 0) + c
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    counted = cut(drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages, parts = sorted(r["lang"] for r in counted.select("lang").distinct().collect()), []
    for at in range(0, len(languages), TOGETHER):
        some = languages[at : at + TOGETHER]
        own = counted.where(F.col("lang").isin(some)).toPandas()
        own = [own[own["lang"] == lang] for lang in some]
        parts.append(build(some, order, [(p["gram"].to_numpy().astype(np.uint64), p["n"].to_numpy().astype(np.float64)) for p in own]))
    return Models(parts)


def identify(df: DataFrame, model: Models, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", rate_col: str = "bits_per_byte") -> DataFrame:
    """Adds language, its probability among the learned ones, and bits a byte under it.

    Null text, or text without a letter, or an empty model: ``und``, 0 and null. Rows are judged alone, so repeated
    ones are alike; an empty table gives no rows; a very long text takes some 60 bytes for each of its own. All columns
    stay; one named like an added one is replaced. Ties go to the language first by name.
    """
    df = df.drop(lang_col, score_col, rate_col)
    schema = df.withColumns({lang_col: F.lit(""), score_col: F.lit(0.0), rate_col: F.lit(None).cast("double")}).schema
    fields = schema.names
    groups, languages = model.groups(MOST_BYTES) or [model], model.languages
    lengths = "code lengths"
    if len(groups) > 1:
        # more than a worker is to hold: a group of models at a time measures all texts, which are written in between
        df = df.withColumn(lengths, F.array().cast("array<double>"))
        for group in groups:
            df = cut(_measured(df, group, text_col, lengths), "lengths")
        groups = []
    shipped = df.sparkSession.sparkContext.broadcast(groups[0]) if groups else None

    def score(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.string())
            if shipped:
                bits = shipped.value.bits(texts)
            else:
                bits = np.array(batch.column(lengths).flatten()).reshape(len(texts), len(languages))
            names, scores, rates = judged(languages, texts, bits)
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != lengths]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], fields)

    return df.mapInArrow(score, schema)


def _measured(df: DataFrame, group: Models, text_col: str, lengths: str) -> DataFrame:
    """``df`` with the code lengths under a group of languages added to those it has."""
    shipped = df.sparkSession.sparkContext.broadcast(group)  # MOST_BYTES, or one model

    def each(batches):
        for batch in batches:
            known = np.array(batch.column(lengths).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            both = np.hstack([known, shipped.value.bits(batch.column(text_col).cast(pa.string()))])
            column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * both.shape[1], pa.int32()), pa.array(both.ravel()))
            at = batch.schema.get_field_index(lengths)
            yield batch.set_column(at, lengths, column)

    return df.mapInArrow(each, df.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row may not be learned from: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_on_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> Models:
    return fit(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), **options)
