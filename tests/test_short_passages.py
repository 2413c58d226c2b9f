"""passages_in_documents against its SQL on passages of one to twelve words, whole and cut within words."""

import random

import duckdb

from quarry import registry


def test_short_passages(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.choice((1, 2, 3, 5, 9, 14)))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    items = []
    for n in range(1, 13):
        for _ in range(6):
            own = rng.choice(texts).split(" ")
            at = rng.randrange(1, 27)
            passage = " ".join(own[at : at + n])
            items += [passage, passage[rng.randrange(3) :], passage[: len(passage) - rng.randrange(3)], passage[1:-1], passage + "x", "z" + passage, passage.upper()]
    items += ["", " ", None, "the end", texts[0], "'" + texts[1][5:9] + "'"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate([*texts, None, "", "one"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = {r[0] for r in con.sql(registry.oracle_sql()["passages_in_documents"]).fetchall()}
    got = [r.item_id for r in registry.queries()["passages_in_documents"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    lengths = {len((items[i] or "").split()) for i in expected}
    assert set(range(1, 13)) <= lengths
