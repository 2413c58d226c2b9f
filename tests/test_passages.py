import random

from pyspark.sql import functions as F

from quarry.operators import passages, ranking


def test_against_brute_force(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab é漢") for _ in range(60)) for _ in range(80)] + [None, ""]
    items = [(i, "".join(r.choice("ab é漢") for _ in range(r.randint(1, 7)))) for i in range(300)] + [(300, ""), (301, None), (302, texts[0]), (302, texts[1]), (303, texts[0])]
    want = sorted(i for i, x in items if x is not None and any(t is not None and x in t for t in texts))
    a = spark.createDataFrame([(i, x, "q") for i, x in items], "i int, x string, said string")
    b = spark.createDataFrame([(t, "q") for t in texts], "x string, id string").repartition(5)
    for size in (20, 200, 1 << 20):
        got = passages.found_in_texts(a, b, "i", F.col("x"), F.col("x"), set_chars=size)
        assert sorted(r.id for r in got.collect()) == want
    assert passages.found_in_texts(a, b.where("false"), "i", F.col("x"), F.col("x")).count() == 0
    assert passages.found_in_texts(a.where("false"), b, "i", F.col("x"), F.col("x")).count() == 0


def test_an_item_that_all_texts_hold_is_told_once_a_task(spark):
    a = spark.createDataFrame([(1, "common"), (2, "rare one"), (3, "never")], "i int, x string")
    b = spark.range(20_000).select(F.concat(F.lit("so common a text "), F.when(F.col("id") == 777, "and a rare one").otherwise(F.col("id").cast("string"))).alias("x")).repartition(4)
    said = b.select(F.col("x").alias("text")).mapInArrow(passages._search(b, ["common", "rare one", "never"]), "said string")
    assert sorted(r.said for r in said.collect()) == ["common"] * 4 + ["rare one"]
    assert sorted(r.id for r in passages.found_in_texts(a, b, "i", F.col("x"), F.col("x")).collect()) == [1, 2]


def test_budget_with_rows_that_seldom_fit(spark, monkeypatch):
    """Large rows between small ones: a round each would be needed, were it not for the stream."""
    costs = [c for k in range(24, 0, -1) for c in (1, k)]
    rows = [(g, i, float(-i), c) for g in ("a", None) for i, c in enumerate(costs)] + [("b", i, 0.0, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, id int, o double, cost int").repartition(3)
    want = set()
    for g in ("a", None, "b"):
        room = 24
        for _, i, _, c in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if c <= room:
                want.add((g, i))
                room -= c
    cuts, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, name: cuts.append(name) or cut(df, name))
    assert set(map(tuple, ranking.skipping_budget(df, ["g"], "id", "cost", 24, "o").collect())) == want and len(cuts) <= 2 * ranking.ROUNDS


def test_budget_reads_texts_only_of_what_is_kept(spark, monkeypatch):
    rows = [("k", i, i % 3, "text " * 50) for i in range(60)] + [("k", 7, 1, "again")]
    df = spark.createDataFrame(rows, "g string, id int, cost int, text string").repartition(3)
    written, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, name: written.append(df.columns) or cut(df, name))
    got = ranking.within_budget(df, ["g"], "cost", 10, "-id").collect()
    want = [i for i in range(59, -1, -1) if sum(k % 3 for k in range(i, 60)) <= 10]
    assert sorted(r.id for r in got) == sorted(want)
    assert all("text" not in columns for columns in written) and got[0].asDict().keys() == {"g", "id", "cost", "text"}
    twice = ranking.within_budget(df.where("id in (7, 8)"), ["g"], "cost", 3, "-id").collect()
    assert sorted(r.id for r in twice) == [7, 8]  # 8 costs 2 and one of the two rows of 7 the rest
