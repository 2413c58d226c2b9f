import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from quarry.llm import secret_scan as S
from quarry.llm.queries import op9_secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], S.KINDS.index(s[0])))


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


HARD = [
    'password = "hunter22" passwd:abc secret=  \'x.y-z=/+_1\'', "TOKEN=abcdef apiKey: 123456 API_KEY='short'", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "AKIAAKIA", "deadbeef" * 3 + "g" + "0" * 23,
    "token token=secret=abcdefg", "toKen : éabcdefg", "ſecret=abcdefgh Kapi_key=abcdefgh", "😀 secret=abcdefgh", "password\n=abcdefgh", "token='" + "0123456789abcdef" * 2 + "'",
]


def test_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in df.select("text", S.as_text(S.base_spans(F.col("text"))).alias("spans")).collect():
        assert r.spans == line(brute(r.text)), r.text


def test_whole_table(spark, sf_dir, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = op9_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in S.KINDS[:3]]
        assert set(filter(None, line(base).split(","))) <= set(r.spans.split(","))


def test_random_keys_are_found_and_words_left(spark):
    """Keys of three encodings pass the battery; long identifiers of words don't."""
    rng = random.Random(8)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = [f"see {key(string.ascii_letters + string.digits + '+/', 44)} here" for _ in range(30)]
    words = [f"see {'MostRecentValueOfUserNamed'}{n:04d}OrTheOneBeforeItInTheList here" for n in range(200)]
    df = spark.createDataFrame(list(enumerate(keys + words)), "doc_id long, text string")
    out = S.scan_secrets(df, S.control(df))
    hit = {r.doc_id for r in out.where(F.size("secret_spans") > 0).select("doc_id").collect()}
    assert len(hit & set(range(30))) >= 27 and len(hit - set(range(30))) <= 20


def test_edges(spark, edge_documents):
    limits = S.control(edge_documents)
    out = S.scan_secrets(edge_documents, limits)
    assert out.count() == edge_documents.count()
    assert all(r.secret_spans == [] for r in out.where("text is null or text = ''").collect())
    empty = edge_documents.where("false")
    assert S.scan_secrets(empty, S.control(empty)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def _identifier(rng, n):
    words = "most recent value user named before item list order total count index price child parent window buffer handle offset record stream client server request response account".split()
    out = ""
    while len(out) < n - 2:
        out += rng.choice(words).capitalize()
    return out[: n - 2] + str(rng.randrange(10, 100))


def test_false_share_in_every_stratum(spark):
    """Of reported runs at most the rate (and some noise) are words written together, at every length; most keys of 28 and more are found."""
    rng = random.Random(11)
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"]
    vocabulary = [_identifier(rng, 12)[:-2].lower() for _ in range(400)]
    rows, truth = [], {}
    for least in S.STRATA:
        for n in range(120):
            letters = alphabets[n % 3]
            key = "".join(rng.choice(letters) for _ in range(least + n % 4))
            truth[len(rows)] = (least, any(c.isdigit() for c in key) and any(c.isalpha() for c in key))
            rows.append(f"prose before {key}")
        for _ in range(300):
            truth[len(rows)] = (least, None)
            rows.append(" ".join(rng.choice(vocabulary) for _ in range(60)) + f" then {_identifier(rng, least + rng.randrange(4))} and on")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    hit = {r.doc_id for r in S.find_secrets(df).where(F.size("secret_spans") > 0).select("doc_id").collect()}
    for least in S.STRATA:
        mine = [i for i in hit if truth[i][0] == least]
        false = sum(truth[i][1] is None for i in mine)
        assert false <= 0.05 * len(mine) + 3 * (0.05 * len(mine) + 1) ** 0.5, (least, false, len(mine))
        keys = [i for i, t in truth.items() if t == (least, True)]
        assert least < 28 or sum(i in hit for i in keys) >= 0.6 * len(keys), (least, len(keys), sum(i in hit for i in keys))


def test_many_matches_and_a_long_text(spark):
    """Places stay right over blocks of matches; a text of 50 MB and a run of a megabyte pass."""
    text = " ".join(f"token={i:06d}" for i in range(700))
    long = spark.range(1).selectExpr("cast(1 as long) as doc_id", "concat(repeat('some words of prose here and there ', 1430000), repeat('Ab1', 300000), ' token=abcdefg') as text")
    df = spark.createDataFrame([(0, text)], "doc_id long, text string").unionByName(long)
    rows = {r.doc_id: r for r in S.find_secrets(df).collect()}
    assert [(s.start, s.end) for s in rows[0].base_spans] == [m[1:] for m in brute(text)]
    assert len(rows[1].base_spans) == 1


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "secret=abcdefg")] * 3 + [(1, "secret=abcdefg")], "doc_id long, text string")
    rows = S.find_secrets(df).collect()
    assert len(rows) == 4 and len({str(r) for r in rows}) == 1
