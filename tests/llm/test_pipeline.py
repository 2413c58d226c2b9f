import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from quarry.llm import stages
from tests.llm.test_line_dedup import brute as lines_by_brute_force
from tests.llm.test_ngram_join import brute as classes_by_brute_force


@pytest.fixture(scope="module")
def steps(spark, sf_dir, documents, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("steps"), documents, [documents]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_language_keeps_every_lettered_document(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert after == {i: t for i, t in before.items() if any(map(str.isalpha, t or ""))}


def test_lines(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    expected = lines_by_brute_force(before, 1)
    assert texts(steps[2]) == {i: t for i, (_, gone, t) in expected.items() if not gone or t.strip()}
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_class(steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert set(texts(steps[3])) == {i for i, (_, c) in classes_by_brute_force(before, 5, 80).items() if i == c}


def test_mix_loses_nothing(steps):
    counts = Counter(r.doc_id for r in steps[4].collect())
    assert set(counts) == set(texts(steps[3])) and set(counts.values()) <= {1, 2}


def test_tokens(steps):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = texts(steps[4])
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r.ids == encode(own[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(own[r.doc_id].encode()).hexdigest()


def test_run_is_its_stages(spark, sf_dir, steps):
    key = lambda r: (r.doc_id, r.n_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, steps[-1].collect()))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_edges(spark, sf_dir, edge_documents, stage):
    docs = edge_documents.union(edge_documents)
    out = stage(spark, docs, sf_dir)
    out.collect()
    if stage is not stages.token_ids:
        assert out.columns == docs.columns
    assert stage(spark, docs.where("false"), sf_dir).count() == 0
