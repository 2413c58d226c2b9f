"""Tiered lexical search with Hangul-aware fuzzy matching.

``docs``: doc_id, kind, title, workbook, space, path, summary, key_terms array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.udfs import jamo, letters
from quarry.operators.ranking import with_quota

# What a match in each place is worth.
WORTH = {
    "title_exact": 1.0, "title_prefix": 0.95, "workbook_exact": 0.95, "workbook_substring": 0.88, "workbook_substring_ns": 0.86, "title_substring": 0.85,
    "title_substring_ns": 0.83, "space_substring": 0.82, "key_term_exact": 0.80, "key_term_substring": 0.65, "path_substring": 0.55, "path_substring_ns": 0.53,
    "summary_substring": 0.40, "summary_substring_ns": 0.38,
}
FUZZY_LEAST, FUZZY_BASE, FUZZY_RANGE, FUZZY_LETTERS, WORKBOOK_LESS = 0.6, 0.45, 0.10, 4, 0.03


def prepared(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Documents with the forms that scoring compares; written once, they serve every query."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    names = ("title", "workbook", "space", "path", "summary")
    out = docs.withColumns({f"{c}_l": low(c) for c in names} | {f"{c}_ns": X.joined_form(low(c)) for c in names if c != "space"})
    out = out.withColumn("terms_l", F.transform(F.coalesce("key_terms", F.array().cast("array<string>")), F.lower))
    if fuzzy:
        out = out.withColumns({"title_j": jamo(F.col("title_l")), "workbook_j": jamo(F.col("workbook_l"))})
        out = out.withColumns({c: X.bigrams(F.col(c)) for c in ("title_j", "workbook_j")})
    return out


def score(query: str, fuzzy: bool = True) -> Column:
    """(score, via, text) of one prepared document for a query; null without a match. The first rule that holds decides."""
    low = query.strip().lower()
    q, ns, own = F.lit(low), X.joined_form(F.lit(low)), letters(low)
    col, has = F.col, lambda c: F.col(c) != ""
    cut = F.when(F.length("summary") > 80, F.concat(F.left("summary", F.lit(80)), F.lit("..."))).otherwise(F.col("summary"))
    inside = lambda c: (ns != "") & has(f"{c}_ns") & col(f"{c}_ns").contains(ns)
    rules = [
        ("title_exact", col("title_l") == q, col("title")),
        ("title_prefix", col("title_l").startswith(q), col("title")),
        ("workbook_exact", has("workbook_l") & ((col("workbook_l") == q) | F.array_contains(F.split("workbook_l", r"\s+"), q)), col("workbook")),
        ("workbook_substring", has("workbook_l") & col("workbook_l").contains(q), col("workbook")),
        ("workbook_substring_ns", inside("workbook"), col("workbook")),
        ("title_substring", col("title_l").contains(q), col("title")),
        ("title_substring_ns", inside("title"), col("title")),
        ("space_substring", has("space_l") & col("space_l").contains(q), col("space")),
        ("key_term_exact", F.array_contains("terms_l", q), _term(q, lambda t: t == q)),
        ("key_term_substring", F.exists("terms_l", lambda t: t.contains(q)), _term(q, lambda t: t.contains(q))),
        ("path_substring", col("path_l").contains(q), col("path")),
        ("path_substring_ns", inside("path"), col("path")),
        ("summary_substring", col("summary_l").contains(q), cut),
        ("summary_substring_ns", inside("summary"), cut),
    ]
    hit = lambda worth, via, text: F.struct(worth.cast("double").alias("score"), F.lit(via).alias("via"), F.coalesce(text, F.lit("")).alias("text"))
    out = F.when(q == "", None)
    for via, holds, text in rules:
        out = out.when(holds, hit(F.lit(WORTH[via]), via, text))
    if fuzzy:
        for place, less in (("title", 0.0), ("workbook", WORKBOOK_LESS)):
            ratio = X.overlap_ratio(F.lit(sorted({own[i : i + 2] for i in range(len(own) - 1)})) if len(own) > 1 else F.array().cast("array<string>"), col(f"{place}_j"))
            worth = FUZZY_BASE - less + FUZZY_RANGE * (ratio - FUZZY_LEAST) / (1 - FUZZY_LEAST)
            out = out.when(F.lit(len(own) >= FUZZY_LETTERS) & (ratio >= FUZZY_LEAST), hit(worth, f"{place}_fuzzy_jamo", col(place)))
    return out


def _term(q: Column, holds) -> Column:
    pairs = F.filter(F.arrays_zip(F.col("key_terms").alias("t"), F.col("terms_l").alias("l")), lambda p: holds(p["l"]))
    return F.get(pairs, F.lit(0))["t"]


def search(docs: DataFrame, query: str, limit: int = 50, kinds: list[str] | None = None, balance: bool = True, fuzzy: bool = True) -> DataFrame:
    """(doc_id, kind, score, via, text) of the best documents: the best of the query's words, or all of them joined; 0.05 more if every word is found."""
    words = list(dict.fromkeys(query.split()))
    if not words:
        return docs.select("doc_id", "kind", F.lit(0.0).alias("score"), F.lit("").alias("via"), F.lit("").alias("text")).where("false")
    rows = docs.where(F.col("kind").isin(*kinds)) if kinds else docs
    hits = [score(w, fuzzy) for w in words]
    if len(words) > 1:
        joined = score("".join(words), fuzzy)
        hits.append(F.when(joined.isNotNull(), F.struct(joined["score"].alias("score"), F.concat(joined["via"], F.lit("_joined")).alias("via"), joined["text"].alias("text"))))
    found = rows.select("doc_id", "kind", F.array(*hits).alias("hits"))
    first = F.aggregate("hits", F.lit(None).cast("struct<score:double,via:string,text:string>"), lambda a, h: F.when(h.isNotNull() & (a.isNull() | (h["score"] > a["score"])), h).otherwise(a))
    every = F.forall(F.slice("hits", 1, len(words)), lambda h: h.isNotNull()) if len(words) > 1 else F.lit(False)
    found = found.withColumns({"b": first, "every": every}).where("b is not null")
    value = F.when(F.col("every"), F.least(F.lit(1.0), F.col("b.score") + 0.05)).otherwise(F.col("b.score"))
    out = found.select("doc_id", "kind", F.bround(value, 6).alias("score"), "b.via", "b.text")
    order = (F.desc("score"), F.asc("doc_id"))
    return with_quota(out, "kind", limit, *order) if balance and not kinds else out.orderBy(*order).limit(limit)


def distinct_docs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One document of each key: the longer path, then the longer summary, then the smaller id."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.length("path")), F.desc(F.length(F.coalesce("summary", F.lit("")))), "doc_id"))
    return docs.withColumn("place", place).where("place = 1").drop("place")


def palette(items: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Items by the better of their title's score plus 10 and their path's."""
    from quarry.functions.udfs import subsequence_score

    q = F.lit(query.strip())
    title, path = subsequence_score(q, F.col("title")) + 10, subsequence_score(q, F.col("path"))
    return items.withColumn("score", F.greatest(title, path)).where("score is not null").orderBy(F.desc("score"), "title", "path").limit(limit)


def grouped_hits(hits: DataFrame, parent: str, item: str) -> DataFrame:
    """(group, items, size): hits of one folder together if it has two or more, others alone."""
    counted = hits.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(parent)))
    key = F.when(F.col("n") >= 2, F.col(parent)).otherwise(F.col(item))
    return counted.withColumn("group", key).groupBy("group").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("size"))


def folded(hits: DataFrame, workbook: str, sheet: str, score_col: str, limit: int) -> DataFrame:
    """Hits by workbook: summed score to three places, sheets by score, the best hit's sheet, and rank."""
    out = hits.groupBy(workbook).agg(F.bround(F.sum(score_col), 3).alias("total"), F.array_sort(F.collect_list(F.struct((-F.col(score_col)).alias("o"), F.col(sheet).alias("sheet")))).alias("s"))
    out = out.select(workbook, "total", F.array_distinct(F.transform("s", lambda x: x["sheet"])).alias("sheets"), F.get("s", F.lit(0))["sheet"].alias("seed"))
    top = out.orderBy(F.desc("total"), workbook).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), workbook)))


def merged(*results: DataFrame) -> DataFrame:
    """(doc_id, score, source) over several result lists: the best score, and ``both`` where more than one found it."""
    out = None
    for r in results:
        out = r if out is None else out.unionByName(r)
    return out.groupBy("doc_id").agg(F.max("score").alias("score"), F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"))


def confidence(hits: DataFrame, high: float = 0.95, enough: int = 3) -> DataFrame:
    """One row of signals for the decision to search on: best score, titles found, strong hits, and whether they are enough."""
    signals = hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"), F.count_if(F.col("via").startswith("title")).alias("titles"), F.count_if(F.col("score") >= 0.85).alias("strong"))
    return signals.withColumn("stop", (F.col("best") >= high) & (F.col("titles") > 0) & (F.col("strong") >= enough))
