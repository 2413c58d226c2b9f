"""N-gram Jaccard join by adaptive multi-match prefixes, and its connected classes.

Documents with equal shingle sets are one class. Document frequencies of all shingles of
all classes order each set from rare to frequent. A set of n shingles with threshold t may
lose n - ceil(t n) of them, so two linked sets share l of their first n - ceil(t n) + l
shingles. Each set picks its own l: a longer prefix costs more postings, but asks for more
shared prefix shingles and so leaves fewer candidates to verify.

Shingles that one class alone holds match nothing and are never sent. Postings are first
verified against their smallest class, a star for each shingle; only pairs that this leaves
in unlike components go on to the multi-match count, so groups of near copies never
become all of their pairs, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected_components

from . import chunks as C
from .shared import cut
from .words import mix, shingle_sets

_LAST = np.iinfo(np.int64).max
#: Most matches that a prefix may ask for; classes of a posting that one task compares with another such block.
MOST_MATCHES, BLOCK = 64, 1024
#: What a shingle in a prefix costs beside the classes that it is compared with.
SEND = 20
#: Rounds in which each class tries its most promising partner only, before all that are left.
TRIES = 1


def least_overlap(n, percent: int):
    """Of a set of n: shingles that it shares at least with any set that it links with."""
    return -(-n * percent // 100)


def _digest(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two digests of a set: sums of unlike mixes of its shingles. ``bits`` narrows the first, for tests."""
    size = np.uint64(len(own))
    a, b = (int(mix((mix(own ^ np.uint64(seed)).sum(dtype=np.uint64) + size).reshape(1))[0].view(np.int64)) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return a >> (64 - bits), b


def _sets(texts, shingle: int) -> list[np.ndarray]:
    return shingle_sets(texts, shingle)


def prefix_matches(df: np.ndarray, n: int, percent: int) -> int:
    """How many prefix matches l a set asks for, from the frequencies of its shingles in order (rare first, 1 for those that match nothing).

    A prefix costs its shingles and their postings; every candidate that it leaves costs a verification,
    about a tenth of a posting for each shingle of the set. Candidates are at most postings / l.
    """
    lose = n - least_overlap(n, percent)
    longest = min(MOST_MATCHES, n - lose)
    postings = np.cumsum(np.where(df > 1, df - 1, 0).astype(np.float64))[lose : lose + longest]
    matches = np.arange(1, longest + 1)
    sent = np.cumsum(df > 1)[lose : lose + longest]
    return int(matches[np.argmin(SEND * sent + postings + postings / matches * (1 + n / 10))])


def classes(dealt: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """For each document, dealt to chunks, its set's size and digests."""

    def digest(table: pa.Table) -> pa.Table:
        ids, texts = C.in_order(table)
        rows = []
        for i, own in zip(ids.tolist(), _sets(texts, shingle), strict=True):
            a, b = _digest(own, bits)
            rows.append((table["chunk"][0].as_py(), i, len(own), a, b))
        return C.columns(rows, [("chunk", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    return dealt.groupBy("chunk").applyInArrow(digest, "chunk int, doc long, n long, a long, b long")


def held_classes(rows: DataFrame) -> DataFrame:
    """(a, b, n, first, chunk, class): documents with equal sets, the least of them, and a number for the class. Needs a cut, as numbers are by place."""
    held = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("doc", "chunk")).alias("at"))
    return held.select("a", "b", "n", F.col("at.doc").alias("first"), F.col("at.chunk").alias("chunk"), F.monotonically_increasing_id().alias("class"))


def prefixes(dealt: DataFrame, held: DataFrame, shingle: int, percent: int, n_buckets: int, bits: int = 64) -> DataFrame:
    """(class, n, matches, rest, own, prefix, shared): of each class with a prefix shingle that another class holds as well.

    ``rest`` is the number of shingles behind the prefix, ``own`` that of those no other class holds, ``prefix`` its shingles with another holder, ``shared``
    all of the set's shingles with another holder (packed).
    """
    held = held.select("chunk", "a", "b", "class")

    def own_sets(table: pa.Table, held: pa.Table):
        """This chunk's classes with their sets; a class is the first row that has its digests."""
        if not held.num_rows:
            return
        left = dict(zip(zip(held["a"].to_pylist(), held["b"].to_pylist(), strict=True), held["class"].to_pylist(), strict=True))
        _, texts = C.in_order(table)
        for own in _sets(texts, shingle):
            number = left.pop(_digest(own, bits), None)
            if number is not None:
                yield number, own

    def probe(table: pa.Table, held: pa.Table) -> pa.Table:
        sets = [own for _, own in own_sets(table, held)]
        keys = np.sort(C.bucket_keys(np.concatenate(sets) if sets else np.empty(0, np.uint64), n_buckets))
        first = C.runs(keys)
        count = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
        bucket = (keys[first] >> np.uint64(32)).astype(np.int32)
        value = (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.r_[C.runs(bucket), len(bucket)].tolist()
        out = [(int(bucket[x]), table["chunk"][0].as_py(), C.pack(value[x:y]), C.pack(np.flatnonzero(count[x:y] > 1).astype(np.uint32)), C.pack(count[x:y][count[x:y] > 1])) for x, y in zip(at[:-1], at[1:], strict=True)]
        return C.columns(out, [("bucket", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        values, row = C.unpack(table["probes"], np.uint32)
        held_by = np.ones(len(values), np.int64)
        start = 0
        for probes, many, counts in zip(table["probes"].to_pylist(), table["many"].to_pylist(), table["counts"].to_pylist(), strict=True):
            held_by[start + np.frombuffer(many, np.uint32).astype(np.int64)] = np.frombuffer(counts, np.uint32)
            start += len(probes) // 4
        order = np.argsort(values, kind="stable")
        first = C.runs(values[order])
        total = np.add.reduceat(held_by[order], first) if len(first) else held_by
        df = np.empty(len(values), np.int64)
        df[order] = np.repeat(total, np.diff(np.r_[first, len(order)]))
        keep = df > 1
        values, row, df = values[keep], row[keep], np.minimum(df[keep], 0xFFFFFFFF).astype(np.uint32)
        at = np.r_[C.runs(row), len(row)].tolist()
        chunk, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
        out = [(chunk[int(row[x])], bucket, C.pack(values[x:y]), C.pack(df[x:y])) for x, y in zip(at[:-1], at[1:], strict=True)]
        return C.columns(out, [("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary()), ("df", pa.binary())])

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        fields = [("class", pa.int64()), ("n", pa.int64()), ("matches", pa.int32()), ("rest", pa.int64()), ("own", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())]
        held = answers.filter(answers["a"].is_valid())
        answers = answers.filter(answers["hits"].is_valid())
        if not table.num_rows or not answers.num_rows or not held.num_rows:
            return C.columns([], fields)
        values, row = C.unpack(answers["hits"], np.uint32)
        known = np.array(answers["bucket"].to_pylist(), np.uint64)[row] << np.uint64(32) | values.astype(np.uint64)
        df = C.unpack(answers["df"], np.uint32)[0]
        order = np.argsort(known)
        known, df = known[order], df[order]
        out = []
        for number, own in own_sets(table, held):
            keys = C.bucket_keys(own, n_buckets)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[at] == keys
            often = np.where(found, df[at], 1)
            n, lose = len(own), len(own) - least_overlap(len(own), percent)
            if (often <= 1).sum() > lose:  # so many shingles of its own that it links with nothing
                continue
            order = np.lexsort((own, often))
            matches = prefix_matches(often[order], n, percent)
            length = lose + matches
            sent = order[:length]
            sent = sent[often[sent] > 1]
            if len(sent):
                out.append((number, n, matches, n - length, int((often <= 1).sum()), own[sent].view(np.int64).tolist(), C.pack(own[found])))
        return C.columns(out, fields)

    asked = dealt.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(probe, "bucket int, chunk int, probes binary, many binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, hits binary, df binary")
    both = answers.withColumns({c: F.lit(None).cast("long") for c in ("a", "b", "class")}).unionByName(held, allowMissingColumns=True)
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(choose, "class long, n long, matches int, rest long, own long, prefix array<long>, shared binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of classes those that link."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"set_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def test(batches):
        for batch in batches:
            nx, ny = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
            x, y = batch.column("set_x"), batch.column("set_y")
            keep = []
            for i in range(batch.num_rows):
                common = len(np.intersect1d(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * (int(nx[i]) + int(ny[i]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("x", "y")], ["x", "y"])

    return both.mapInArrow(test, "x long, y long")


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """Each class with the most typical class of each of its postings, if their sizes allow a link.

    Of near copies that is their original: it has the least shingles of its own.
    """
    postings = sets.select("class", "n", "own", F.explode("prefix").alias("token"))
    centre = postings.groupBy("token").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("odd"), "class", "n")).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    tied = postings.join(centre.select("token", F.col("m.class").alias("x"), F.col("m.n").alias("n_x")), "token").where("x <> class")
    tied = tied.where((F.least("n", "n_x") * 100) >= F.greatest("n", "n_x") * percent)
    return tied.select(F.least("x", "class").alias("x"), F.greatest("x", "class").alias("y")).distinct()


def _crossing(sets: DataFrame, labels: DataFrame, percent: int, block: int, best: bool) -> DataFrame:
    """Pairs of unlike components that share as many prefix shingles as their prefixes ask for.

    Only postings that unlike components share are kept, and of each prefix only their shingles: no others can be
    common to such a pair. A long posting is dealt to blocks, and each two blocks meet in one task. A pair is
    reported by the posting of its smallest shared prefix shingle. With ``best``, each class reports one partner, the
    one with most shared shingles beyond the least number.
    """
    named = sets.select("class", "n", "rest", "prefix").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    postings = named.select("class", "component", F.explode("prefix").alias("token"))
    spread = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    spread = spread.select("token", (1 + F.floor(F.col("size") / block)).cast("int").alias("parts"))
    left = postings.join(spread, "token")
    kept = left.groupBy("class", "component").agg(F.collect_list(F.struct("token", "parts")).alias("kept"))
    whole = kept.join(sets.select("class", "n", "rest"), "class").withColumn("prefix", F.transform("kept", lambda k: k["token"]))
    dealt = whole.select("class", "component", "n", "rest", "prefix", F.explode("kept").alias("k")).select("class", "component", "n", "rest", "prefix", "k.*")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("*", other.alias("other")).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def compare(table: pa.Table) -> pa.Table:
        fields = [("x", pa.int64()), ("y", pa.int64()), ("more", pa.int32())]
        token = np.int64(table["token"][0].as_py())
        part, inner = table["part"].to_numpy(), table["low"][0].as_py() == table["high"][0].as_py()
        node, comp, n, rest = (table[c].to_numpy() for c in ("class", "component", "n", "rest"))
        lists = table["prefix"].combine_chunks()
        who = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
        flat = np.asarray(lists.flatten())
        order = np.argsort(flat, kind="stable")
        who, flat = who[order], flat[order]
        first = C.runs(flat)
        size = np.diff(np.r_[first, len(flat)])
        column = np.repeat(np.cumsum(size > 1) - 1, size)  # of shingles that two or more have
        keep = np.repeat(size > 1, size)
        who, column, n_columns = who[keep], column[keep], int((size > 1).sum())
        own = int((flat[first][size > 1] < token).sum())
        left = np.arange(len(node)) if inner else np.flatnonzero(part == part.min())
        right = left if inner else np.flatnonzero(part != part.min())
        common = np.zeros((len(left), len(right)), np.float32)
        earlier = np.zeros((len(left), len(right)), bool)
        for low, high in _cuts(n_columns, own):
            a, b = np.searchsorted(column, [low, high])
            wide = np.zeros((len(node), high - low), np.float32)
            wide[who[a:b], column[a:b] - low] = 1
            met = wide[left] @ wide[right].T
            common += met
            if high <= own:
                earlier |= met > 0
        found: list[np.ndarray] = []
        top = np.full((2, len(right)), -1, np.int64)
        for low in range(0, len(left), 128):
            rows = left[low : low + 128]
            small, large = np.minimum(n[rows][:, None], n[right]), np.maximum(n[rows][:, None], n[right])
            need = -(-percent * (small + large) // (100 + percent)) - np.maximum(rest[rows][:, None], rest[right])
            more = common[low : low + 128].astype(np.int64) - need
            fits = (comp[rows][:, None] != comp[right]) & (100 * small >= percent * large) & (more >= 0) & ~earlier[low : low + 128]
            if best:
                more = np.where(fits, more, -1)
                j = more.argmax(axis=1)
                i = np.flatnonzero(more[np.arange(len(rows)), j] >= 0)
                found.append(np.stack([node[rows][i], node[right][j[i]], more[i, j[i]]]))
                at = more.argmax(axis=0)
                better = more[at, np.arange(len(right))] > top[0]
                top[:, better] = more[at, np.arange(len(right))][better], node[rows][at[better]]
            else:
                if inner:
                    fits &= node[rows][:, None] < node[right]
                i, j = np.nonzero(fits)
                x, y = node[rows][i], node[right][j]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y), more[i, j]]))
        if best:
            i = np.flatnonzero(top[0] >= 0)
            found.append(np.stack([node[right][i], top[1][i], top[0][i]]))
        x, y, more = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return pa.table([pa.array(x), pa.array(y), pa.array(more.astype(np.int32))], schema=pa.schema(fields))

    pairs = dealt.groupBy("token", "low", "high").applyInArrow(compare, "x long, y long, more int")
    if best:
        pairs = pairs.groupBy("x").agg(F.max(F.struct("more", "y")).alias("b")).select("x", F.col("b.y").alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct() if best else pairs.select("x", "y")


def _cuts(n_columns: int, own: int, width: int = 4096):
    """Stretches of columns, none across ``own``."""
    edges = sorted({*range(0, n_columns, width), own, n_columns})
    return zip(edges[:-1], edges[1:], strict=True)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, shingles_col: str = "n_shingles", component_col: str = "component_id", chunk_bytes: int = C.CHUNK_BYTES, bucket_values: int = C.BUCKET_VALUES, block: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """Documents by classes of linked shingle sets; a row for each input row: id, set size and component.

    Two documents link when 100 * shared shingles >= ``percent`` * shingles of either. Words are runs of anything
    but white space, with A-Z in lower case. A text of fewer words than a shingle has them all as one shingle.
    The component is the smallest id that links lead to. Documents with equal sets link.

    Null, empty and blank texts: no shingles, a component of their own. A null id counts as the largest: it is the
    component only of documents that link with no other. Repeated rows are alike. Empty input: no rows. Other
    columns are not read.

    Sets are compared by 64-bit shingle hashes; a class is known by two 64-bit digests of its set and its size.
    ``digest_bits`` narrows the first, for tests. A very long text is one task's work, with some 150 bytes for each of its own.
    """
    _, n_bytes = C.sizes(docs, text_col)
    dealt = C.in_chunks(docs, id_col, text_col, 1 + n_bytes // chunk_bytes)
    rows = cut(classes(dealt, shingle, digest_bits), "sets")
    held = cut(held_classes(rows), "classes")
    sets = cut(prefixes(dealt, held, shingle, percent, 1 + n_bytes // 6 // bucket_values, digest_bits), "prefixes")
    component = links_of(sets, percent, block)
    own = held.join(component, held["class"] == component["node"], "left").select("a", "b", "n", "first", F.coalesce("component", "class").alias("component"))
    named = own.groupBy("component").agg(F.min("first").alias("name"))
    joined = rows.join(own.join(named, "component").select("a", "b", "n", "name"), ["a", "b", "n"], "left")
    known = lambda c: F.when(c < F.lit(int(_LAST)), c)
    return joined.select(known(F.col("doc")).alias(id_col), F.col("n").alias(shingles_col), known(F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc"))).alias(component_col))


def links_of(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that link with another."""
    links = cut(_verified(_stars(sets, percent), sets, percent), "links")
    for best in (*[True] * TRIES, False):
        labels = cut(_near_labels(links), "labels")
        links = links.unionByName(cut(_verified(_crossing(sets, labels, percent, block, best), sets, percent), "links"))
    return connected_components(links, "x", "y")


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, component) by the smallest class within two links: equal labels mean one component, and stars have one label."""
    both = links.select("x", "y").union(links.select("y", "x"))
    one = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component"))
    two = both.join(one, both["y"] == one["node"]).select(F.col("x").alias("node"), "component")
    return two.unionByName(one).groupBy("node").agg(F.min("component").alias("component"))
