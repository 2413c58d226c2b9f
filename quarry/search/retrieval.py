"""Layers of chunk retrieval and their fusion.

``chunks``: id, workbook, sheet, section_path, text, tokens, embedding array<float>.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.ranking import running_sum, skipping_budget, within_budget

# Parts of the structural and of the phrase score, and of their fusion.
BASE, BY_TERMS, BY_SECTION, BY_SHEET, SHEET_MOST, BY_EXACT, BY_FORCE, MOST = 0.6, 0.3, 0.2, 0.2, 0.3, 0.3, 0.8, 1.5
PHRASE_BASE, BY_RATIO, BY_COMPOUND, COMPOUND_MOST = 0.70, 0.15, 0.15, 0.25
SEEN_AGAIN, FILTERED_NEW, COMPOUND_MORE, PHRASE_MORE, BY_GRAPH = 1.2, 1.5, 0.15, 0.05, 0.5


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a constant vector; null for a null, zero or unlike-length vector."""
    asked = F.lit([float(x) for x in query]) if query else F.array().cast("array<double>")
    square = sum(x * x for x in query)
    dot = F.aggregate(F.zip_with(vector, asked, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when((F.size(vector) == len(query)) & (norm > 0) & F.lit(square > 0), dot / F.sqrt(norm * F.lit(square)))


def nearest(chunks: DataFrame, query: list[float], k: int, id_col: str = "id", where: Column | None = None) -> DataFrame:
    """The k chunks of greatest cosine; ties by id. One pass, and k rows from each task."""
    rows = chunks if where is None else chunks.where(where)
    scored = rows.withColumn("score", F.bround(cosine(F.col("embedding"), query), 9)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


#: Components of chunks, and of queries, that one task multiplies.
CHUNK_TILE, QUERY_SET = 1 << 21, 1 << 18


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_id: str = "query_id", tile: int = CHUNK_TILE, query_set: int = QUERY_SET) -> DataFrame:
    """(query_id, id, score, rank): the k chunks of greatest cosine of each stated query, against all chunks; ties by id.

    Tiles of chunks meet sets of queries, one matrix product each, and hand on k rows for each query. Vectors that are null, zero,
    or hold a null have no score, nor have vectors of unlike length; repeated query rows are one.
    """
    whole = lambda df, key, name: df.select(F.col(key).alias(name), F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))
    stored, asked = whole(chunks, id_col, "id"), whole(queries, query_id, "query").distinct()
    n_tiles, n_sets = (1 + (df.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) // most for df, most in ((stored, tile), (asked, query_set)))
    dealt = lambda df, n, own, name, n_other, other: df.withColumns({own: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})
    types = {name: df.schema[name].dataType.simpleString() for df, name in ((stored, "id"), (asked, "query"))}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", right.schema.field("query").type), ("id", left.schema.field("id").type), ("score", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending")], null_placement="at_start"))
        x, y = (np.array(t["v"].combine_chunks().flatten(), np.float64).reshape(len(t), -1) for t in (left, right))
        tables = []
        with np.errstate(all="ignore"):
            norm = np.linalg.norm(x, axis=1)
            for q in range(len(y)):
                score = np.round(x @ y[q] / (norm * np.linalg.norm(y[q])), 9)
                known = np.flatnonzero(~np.isnan(score))
                if len(known) > k:
                    known = known[score[known] >= np.partition(score[known], len(known) - k)[len(known) - k]]
                known = known[np.argsort(-score[known], kind="stable")][:k]
                tables.append(pa.table([right["query"].take(pa.array([q] * len(known), pa.int64())), left["id"].take(pa.array(known, pa.int64())), score[known]], schema=schema))
        return pa.concat_tables(tables)

    keys = ["tile", "set", "dim"]
    a, b = dealt(stored, n_tiles, "tile", "id", n_sets, "set").groupBy(*keys), dealt(asked, n_sets, "set", "query", n_tiles, "tile").groupBy(*keys)
    found = a.cogroup(b).applyInArrow(best, f"query {types['query']}, id {types['id']}, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias(query_id), F.col("id").alias(id_col), "score", "rank")


# What parts a sheet's number from its name, by precedence.
SHEET_MARKS = (":", "_", "—", "-")


_LOW = ("low text", "low section", "low sheet", "own sheet", "own words")


def _lowered(chunks: DataFrame) -> DataFrame:
    """What scores read of chunks, in lower case, once for each chunk whatever asks for it."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own = low("sheet")
    for mark in reversed(SHEET_MARKS):  # the first of them that a name holds parts it, wherever the others stand
        own = F.when(low("sheet").contains(mark), F.regexp_replace(low("sheet"), rf"(?s)\A[^{mark}]*{mark}", "")).otherwise(own)
    rows = chunks.withColumns({"low text": low("text"), "low section": low("section_path"), "low sheet": low("sheet"), "own sheet": F.trim(own)})
    return rows.withColumn("own words", F.size(F.split("own sheet", r"\s+")))


def _structural_score(terms: Column, query: Column, forced: dict[str, str] | None = None) -> Column:
    """The score of a chunk of a named workbook by a query's terms and the query in lower case."""
    hits = lambda c, least=1: F.size(F.filter(terms, lambda t: (F.length(t) >= least) & F.contains(F.col(c), t)))
    in_sheet = hits("own sheet", 2)
    exact = (in_sheet > 0) & (in_sheet >= F.greatest(F.lit(1.0), F.col("own words") * 0.5))
    force = reduce(lambda a, kv: a | (F.contains(query, F.lit(kv[0])) & F.col("low sheet").contains(kv[1].lower())), (forced or {}).items(), F.lit(False))
    score = (
        BASE + BY_TERMS * hits("low text") / F.greatest(F.size(terms), F.lit(1)) + F.when(F.exists(terms, lambda t: F.contains(F.col("low section"), t)), BY_SECTION).otherwise(0.0)
        + F.least(F.lit(SHEET_MOST), BY_SHEET * in_sheet) + F.when(exact, BY_EXACT).otherwise(0.0) + F.when(force, BY_FORCE).otherwise(0.0)
    )
    return F.bround(F.least(score, F.lit(MOST)), 9)


def structural(chunks: DataFrame, workbooks: list[str], query: str, forced: dict[str, str] | None = None) -> DataFrame:
    """All chunks of the named workbooks, scored by the query's terms in text, section and sheet."""
    terms = X.without_particles(X.words(F.lit(query)))
    rows = _lowered(chunks.where(F.col("workbook").isin(*workbooks))).withColumn("terms ", terms)
    return rows.withColumn("score", _structural_score(F.col("terms "), F.lit(query.lower()), forced)).drop("terms ", *_LOW)


#: Pairs of a workbook and a query that meet the workbook's chunks together.
PAIRS = 256


def structural_each(asked: DataFrame, chunks: DataFrame, k: int, forced: dict[str, str] | None = None) -> DataFrame:
    """(workbook, query, id, score, place): the k best chunks of each asked workbook by each query, for all of them at once; ties by id.

    Each pair of workbook and query is scored once, however many ask it, against each distinct chunk: chunks of a workbook that scores can't tell
    apart are one with its k least ids, and among the k best are only chunks of the k best such classes (by score, then least id). A task hands on k classes
    of a pair. Null workbooks and queries ask nothing. A workbook's pairs are dealt, ``PAIRS`` at a time, so one that all ask isn't one task's; their number is counted first.
    """
    pairs = asked.select("workbook", "query").where("workbook is not null and query is not null").distinct()
    pairs = pairs.withColumns({"terms ": X.without_particles(X.words(F.col("query"))), "low ": F.lower("query")})
    total, most = (n or 0 for n in pairs.groupBy("workbook").count().agg(F.sum("count"), F.max("count")).first())
    parts, tasks = 1 + most // PAIRS, 1 + total // (4 * PAIRS)
    alike = W.partitionBy("workbook", *_LOW).orderBy("id")
    rows = _lowered(chunks).select("id", "workbook", *_LOW).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k)
    rows = rows.groupBy("workbook", *_LOW).agg(F.array_sort(F.collect_list(F.struct("id"))).alias("ids"))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).repartition(tasks, "workbook", "part")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "workbook", "part")
    rows = rows.join(pairs.hint("merge"), ["workbook", "part"]).select("workbook", "part", "query", "ids", _structural_score(F.col("terms "), F.col("low "), forced).alias("score"))
    best = lambda df, tie: df.withColumn("place", F.row_number().over(W.partitionBy("workbook", "part", "query").orderBy(F.desc("score"), tie))).where(F.col("place") <= k)
    classes = best(rows, F.col("ids")[0]["id"]).drop("place")
    return best(classes.select("workbook", "part", "query", F.inline("ids"), "score"), F.col("id")).drop("part")


def phrase_search(chunks: DataFrame, phrases: list[str], k: int = 10) -> DataFrame:
    """The k chunks with most of the phrases, word by word; ``compound`` says whether one of several words is among them."""
    if not phrases:
        return chunks.withColumns({"score": F.lit(0.0), "compound": F.lit(False)}).where("false")
    found = F.filter(F.array(*[F.when(F.contains("text", F.lit(p)), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())
    several = F.size(F.filter(found, lambda p: p.contains(" ") | p.contains("_")))
    score = PHRASE_BASE + BY_RATIO * F.size(found) / len(phrases) + F.least(several * BY_COMPOUND, F.lit(COMPOUND_MOST))
    out = chunks.withColumns({"score": F.bround(F.least(score, F.lit(1.0)), 9), "compound": several > 0}).where(F.size(found) > 0)
    return out.orderBy(F.desc("score"), "id").limit(k)


def graph_layer(chunks: DataFrame, edges: DataFrame, systems: list[str], query: str, neighbours: int = 5, per_system: int = 3) -> DataFrame:
    """Of up to five neighbours of each of three systems the best three chunks, at half their score."""
    starts = systems[:3]
    near = edges.where(F.col("src").isin(*starts) & ~F.col("dst").isin(*systems)).select("src", "dst").distinct()
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    names = [r["dst"] for r in near.withColumn("p", place).where(F.col("p") <= neighbours).select("dst").distinct().collect()]
    if not names:
        return chunks.withColumn("score", F.lit(0.0)).where("false")
    rows = structural(chunks, names, query)
    best = rows.withColumn("p", F.row_number().over(W.partitionBy("workbook").orderBy(F.desc("score"), "id"))).where(F.col("p") <= per_system).drop("p")
    return best.withColumn("score", F.col("score") * BY_GRAPH)


def fused(base: DataFrame, vector: DataFrame, filtered: DataFrame, phrase: DataFrame) -> DataFrame:
    """(id, score, layers) of the layers' (id, score): the best of structural and graph; a vector hit again counts a fifth more, a new one of a filtered search half more; phrases raise what they confirm."""
    b = base.groupBy("id").agg(F.max("score").alias("b"))
    v = vector.groupBy("id").agg(F.max("score").alias("v"))
    f = filtered.groupBy("id").agg(F.max("score").alias("f"))
    p = phrase.groupBy("id").agg(F.max("score").alias("p"), F.max("compound").alias("compound"))
    all_ = b.join(v, "id", "full_outer").join(f, "id", "full_outer").join(p, "id", "full_outer")
    first = F.when(F.col("b").isNotNull() & F.col("v").isNotNull(), F.col("b") * SEEN_AGAIN).otherwise(F.coalesce("b", "v", F.col("f") * FILTERED_NEW))
    more = F.when(F.col("compound"), COMPOUND_MORE).otherwise(PHRASE_MORE)
    score = F.when(F.col("p").isNull(), first).when(first.isNull(), F.col("p")).otherwise(F.greatest(first, "p") + more)
    layers = F.concat_ws("+", *[F.when(F.col(c).isNotNull(), n) for c, n in (("b", "structural"), ("v", "vector"), ("f", "filtered"), ("p", "fulltext"))])
    return all_.select("id", F.bround(score, 9).alias("score"), layers.alias("layers"))


def assembled(ranked: DataFrame, systems: list[str], top_k: int, budget: int) -> DataFrame:
    """Chunks within a token budget. For two systems or more, each first gets its best few (passing over what doesn't fit), then the rest by score until the first that doesn't fit.

    ``ranked`` (id, workbook, score, tokens) may be all candidates: sums go by ranges of the order.
    """
    order = (F.desc("score"), F.asc("id"))
    if len(systems) < 2:
        return within_budget(ranked, [], "tokens", budget, "-score", "id").orderBy(*order).limit(top_k)
    slots = max(3, top_k // len(systems))
    own = ranked.where(F.col("workbook").isin(*systems))
    own = own.withColumn("p", F.row_number().over(W.partitionBy("workbook").orderBy(*order))).where(F.col("p") <= slots)
    # systems are served in their order: a key that falls with it sorts as a score
    turn = reduce(lambda acc, s: F.when(F.col("workbook") == s[1], F.lit(float(-s[0]))).otherwise(acc), enumerate(systems), F.lit(0.0))
    first = skipping_budget(own.withColumn("turn", turn * 1e6 + F.col("score")), [], "id", "tokens", budget, "turn")
    kept = ranked.join(first, "id", "left_semi")
    used, n = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    rest = within_budget(ranked.join(first, "id", "left_anti"), [], "tokens", budget - used, "-score", "id").orderBy(*order).limit(max(0, top_k - n))
    return kept.unionByName(rest.select(*ranked.columns)).orderBy(*order)


def whole_sheets(chunks: DataFrame, hits: DataFrame, budget: int = 80_000, least_left: int = 500) -> DataFrame:
    """All chunks of the hits' sheets, best sheet first, within a token budget; of the first sheet that doesn't fit as many chunks as do, if ``least_left`` tokens are left."""
    sheets = hits.groupBy("workbook", "sheet").agg(F.max("score").alias("sheet_score"))
    rows = chunks.join(sheets, ["workbook", "sheet"])
    sizes = running_sum(rows.groupBy("workbook", "sheet", "sheet_score").agg(F.sum("tokens").alias("size")), [], "size", F.desc("sheet_score"), F.asc("workbook"), F.asc("sheet"), out="upto")
    sizes = sizes.withColumn("left", budget - F.col("upto") + F.col("size")).where((F.col("size") <= F.col("left")) | (F.col("left") >= least_left)).where("left > 0")
    rows = rows.join(sizes.select("workbook", "sheet", "left"), ["workbook", "sheet"])
    return running_sum(rows, ["workbook", "sheet"], "tokens", F.asc("id"), out="upto").where("upto <= left").drop("upto", "left")


def alias_hits(queries: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, target, alias): longest aliases first, none over places already taken, the best target of each, at most ``most``.

    ``aliases``: alias, target, weight. Candidates are found by words; the greedy choice is a fold over one query's own.
    """
    import pandas as pd

    from quarry.operators.joins import containing

    met = containing(aliases.select("alias").distinct(), queries, "alias", "query_id", "query").join(queries, "query_id").join(aliases, "alias")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = [], []
        rows = rows.sort_values(["weight", "target"], ascending=[False, True]).drop_duplicates("alias")
        rows = rows.assign(size=rows["alias"].str.len()).sort_values(["size", "alias"], ascending=[False, True])
        for r in rows.itertuples():
            at = r.query.lower().find(r.alias.lower())
            while at >= 0 and any(a < at + len(r.alias) and at < b for a, b in taken):
                at = r.query.lower().find(r.alias.lower(), at + 1)
            if at >= 0 and len(out) < most:
                taken.append((at, at + len(r.alias)))
                out.append((r.query_id, r.target, r.alias))
        return pd.DataFrame(out, columns=["query_id", "target", "alias"])

    kind = dict(queries.dtypes)["query_id"]
    return met.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, target string, alias string")
