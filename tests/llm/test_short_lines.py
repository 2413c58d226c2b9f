"""Lines of every length are judged by default: by the operator, the registered query and the pipeline's stage."""

import hashlib
import random

from quarry.llm import stages
from quarry.llm.line_dedup import line_dedup
from quarry.llm.queries import op6_line_dedup
from tests.llm.test_line_dedup import brute, result


def test_short_lines(spark):
    """Copies and edits of lines around the length at which shared ends take over, menus, and sentences without spaces."""
    rng = random.Random(20)
    seeds = ["".join(rng.choice("abcdéxyz 漢字仮名😀") for _ in range(n)) for n in (1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 18, 19, 20, 21, 22, 24) for _ in range(3)]
    seeds += ["Home", "Contact us", "お問い合わせはこちらから", "a" * 19, "a" * 20, "a" * 21]
    rows = []
    for doc in range(80):
        lines = []
        for _ in range(4):
            line = list(rng.choice(seeds))
            for _ in range(rng.choice((0, 0, 1, 2))):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(2)] = rng.choice(("", "q", "漢"))
            lines.append("".join(line))
        rows.append((doc, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(line_dedup(df)) == brute(rows, 1)


def test_repeated_menu_goes(spark):
    rows = [(i, f"Home\nContact\n{'word ' * i}{i * 7919}") for i in range(2, 6)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in stages.fresh_lines(spark, df, "").collect()}
    assert left[2].startswith("Home\nContact\n") and not any("Home" in left[i] or "Contact" in left[i] for i in (3, 4, 5))


def test_whole_table(spark, sf_dir, documents):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()], 1)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op6_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256((t or "").encode()).hexdigest()) for i, (n, g, t) in expected.items()}
