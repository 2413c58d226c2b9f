import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm.queries import op1_source_mix
from quarry.llm.source_mix import solve, temperature_mix

TOKENS = {"big": 900_000, "mid": 90_000, "small": 9_000, "none": 0}


def test_bisection_meets_its_target():
    mix = solve(TOKENS, target_entropy=0.6)
    assert abs(mix.entropy / math.log(3) - 0.6) < 1e-9 and abs(sum(mix.weights.values()) - 1) < 1e-12
    mix = solve(TOKENS, max_repeats=5)
    assert abs(max(mix.weights[s] * mix.budget / TOKENS[s] for s in mix.weights) - 5) < 1e-6
    assert min(mix.weights[s] * mix.budget / TOKENS[s] for s in mix.weights) == pytest.approx(1)
    assert solve(TOKENS, target_entropy=0.01).exponent == 1 and solve(TOKENS, max_repeats=1e9).exponent == 0
    assert solve(TOKENS, target_entropy=0.99, max_repeats=2).exponent == solve(TOKENS, max_repeats=2).exponent
    assert solve({}).budget == 0 and solve({"a": 5}, target_entropy=0.5).weights == {"a": 1.0}


def test_budgets_are_met(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", " ".join(["w"] * (1 + i % 17))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(t.split())
    for options in ({"max_repeats": 3}, {"target_entropy": 0.95, "budget": 9000.0}):
        mix = solve(dict(tokens), **options)
        out = temperature_mix(df, **options)
        got = {r.source: r.n for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
        for s, w in mix.weights.items():
            assert w * mix.budget - 18 <= got.get(s, 0) <= w * mix.budget + 1
        per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("mix_pass").alias("p")).collect()
        assert all(r.n == r.p for r in per)
        if "max_repeats" in options:
            assert len(per) == len(rows) and max(r.n for r in per) == 3


def test_order_mixes_whole_blocks(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("x y z").alias("text"))
    rows = [(r.source, r.mix_pass, r.mix_block) for r in temperature_mix(df, max_repeats=4, blocks=64).orderBy("mix_key").collect()]
    changes = sum(x != y for x, y in zip(rows, rows[1:], strict=False)) + 1
    assert changes == len(set(rows))
    half = Counter(s for s, _, _ in rows[: len(rows) // 2])
    assert abs(half["a"] / (len(rows) // 2) - Counter(s for s, _, _ in rows)["a"] / len(rows)) < 0.12


def test_edges(spark, edge_documents):
    out = temperature_mix(edge_documents, max_repeats=2)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in edge_documents.collect()}
    assert set(edge_documents.columns) < set(out.columns)
    assert temperature_mix(edge_documents.where("false"), max_repeats=2).count() == 0
    assert temperature_mix(edge_documents.where("text is null"), max_repeats=2).count() == 1


def test_many_sources(spark):
    """As many sources as documents are mixed like few: by the weights that ``solve`` finds, also where no table of sources is broadcast."""
    rows = [(i, f"host{i % 700}" if i % 3 else "hot", " ".join(["w"] * (1 + (i % 700) % 23))) for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(t.split())
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, options in (("-1", {"target_entropy": 0.98, "budget": 40000.0}), (held, {"max_repeats": 3})):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            mix = solve(dict(tokens), **options)
            got = {r.source: r.n for r in temperature_mix(df, **options).groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
            assert all(w * mix.budget - 24 <= got.get(s, 0) <= w * mix.budget + 1 for s, w in mix.weights.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_whole_table(spark, sf_dir, documents):
    out = op1_source_mix(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in documents.collect()}
