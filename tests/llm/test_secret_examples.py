"""Examples of words written together come from whole texts."""

from pyspark.sql import functions as F

from quarry.llm import secret_scan as S


def test_every_word_counts(spark):
    """Examples grow with the words, and take up all of them but an end too short for a run."""
    texts = [(n, "wordy prose " * n) for n in (0, 1, 2, 10, 400, 4000)]
    rows = spark.createDataFrame(texts, "n long, text string").select("n", S.words_together(F.col("text")).alias("w")).collect()
    turn = sum(S.STRATA) - S.NUMBER * len(S.STRATA)
    for r in rows:
        letters, examples = 10 * r.n, len(r.w)
        assert examples >= letters // turn * len(S.STRATA) and (letters < 16) == (examples == 0), r.n
        taken = sum(S.STRATA[w["stratum"]] - S.NUMBER for w in r.w)
        assert letters < 1000 or taken >= 0.9 * letters, r.n
    assert len(rows[-1].w) > 9 * len(rows[-2].w) > 0


def test_a_word_at_the_end_is_seen(spark):
    """Texts that differ only far from any one place have other examples."""
    head = "some words of prose here and there " * 40
    rows = spark.createDataFrame([(head + "Zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz" * 4,), (head,)], "text string").select(S.words_together(F.col("text")).alias("w")).collect()
    assert len(rows[0].w) > len(rows[1].w)
