"""Measures of search and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(case_id, hit, precision): whether an expected target is among a case's first k, and which share of the first k is expected."""
    top = results.where(F.col("rank") <= k)
    marked = top.join(expected.select("case_id", "target", F.lit(1).alias("right")).distinct(), ["case_id", "target"], "left")
    found = marked.groupBy("case_id").agg(F.max(F.coalesce("right", F.lit(0))).alias("hit"), F.bround(F.sum(F.coalesce("right", F.lit(0))) / F.count(F.lit(1)), 6).alias("precision"))
    return expected.select("case_id").distinct().join(found, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def answer_passes(keywords: Column, source_found: Column) -> Column:
    """Four fifths of the keywords, or half of them with the source."""
    return (keywords >= 0.8) | ((keywords >= 0.5) & source_found)


def verdict(scores: Column) -> Column:
    """PASS with a mean of 4 and no score under 3, PARTIAL with 3 and 2, else FAIL; null without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) < 1, None).when((mean >= 4) & (F.array_min(scores) >= 3), "PASS").when((mean >= 3) & (F.array_min(scores) >= 2), "PARTIAL").otherwise("FAIL")


def must_contain(answer: Column, parts: Column) -> Column:
    """Whether an answer holds all parts; null if none are asked for."""
    return F.when(F.size(parts) > 0, F.forall(parts, lambda p: answer.contains(p)))


def answer_confidence(found: Column, phrases: Column, citations: Column) -> Column:
    return F.when(~found, "none").when(phrases > 0, "low").when(citations >= 2, "high").when(citations == 1, "medium").otherwise("low")


def run_totals(results: DataFrame) -> DataFrame:
    """One row over (case_id, passed, seconds, tool_calls, cost, error, answer_length)."""
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("passed").isNotNull()).alias("eligible"), F.count_if("passed").alias("passed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if((F.col("answer_length") == 0) & F.col("error").isNull()).alias("empty"),
        F.bround(F.avg("seconds"), 3).alias("mean_seconds"), F.bround(F.sum("cost"), 6).alias("cost"), F.sum("tool_calls").alias("tool_calls"),
    )


def pass_rates(results: DataFrame, strategies: list[str]) -> DataFrame:
    """Percent passed by category, a column for each strategy."""
    return results.groupBy("category").pivot("strategy", strategies).agg(F.bround(F.avg(F.col("passed").cast("int")) * 100, 1))


def never_passed(results: DataFrame) -> DataFrame:
    return results.groupBy("case_id").agg(F.bool_or("passed").alias("any")).where("not coalesce(any, false)").select("case_id")


def in_all_runs(runs: list[DataFrame], id_col: str, metric: str) -> DataFrame:
    """The metric of each run, for ids that all have."""
    out = None
    for i, run in enumerate(runs):
        own = run.select(id_col, F.col(metric).alias(f"{metric}_{i + 1}"))
        out = own if out is None else out.join(own, id_col)
    return out


def valid_lines(lines: DataFrame, required: dict[str, str]) -> DataFrame:
    """(line, errors): what is wrong with each line of JSON; required fields by the type of their value."""
    parsed = F.try_parse_json("line")
    kind = {"string": "string", "number": "double", "boolean": "boolean"}
    missing = [F.when(F.try_variant_get(parsed, f"$.{n}", kind[t]).isNull(), F.lit(f"{n}: {t} expected")) for n, t in required.items()]
    errors = F.when(parsed.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(*missing)))
    return lines.select("line", errors.alias("errors"))


def next_id(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the prefix and the greatest number so far plus one, in four digits."""
    number = F.regexp_extract(column, rf"^{prefix}(\d+)$", 1)
    return ids.agg((F.coalesce(F.max(F.when(number != "", number.cast("int"))), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 4, "0")).alias("next_id"))


# What a question asks for, and how much of a comment and of a value it takes.
ASKS, COMMENT_CHARS, VALUE_CHARS = " 의 정확한 값과 상수명은? (DataSheet 우선)", 60, 25


def key_value_questions(rows: DataFrame, file: str, sheet: str, key: str, value: str, comments: list[str]) -> DataFrame:
    """(id, question, must_contain, hint) of each row with a key: what the first comment in Hangul (else the key) names is asked for.

    The value must be in an answer if it is shorter than 25 characters.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    comment = F.coalesce(*[F.when(text(c).rlike("[가-힣]"), text(c)) for c in comments], text(key))
    must = F.when((text(value) != "") & (F.char_length(text(value)) < VALUE_CHARS), F.array(text(key), text(value))).otherwise(F.array(text(key)))
    out = rows.where(text(key) != "").select(F.concat_ws("-", F.lit("kv"), F.lit(file), text(key)).alias("id"), F.concat(F.left(comment, F.lit(COMMENT_CHARS)), F.lit(ASKS)).alias("question"), must.alias("must_contain"))
    return out.withColumn("hint", F.lit(f"DataSheet / {sheet}"))
