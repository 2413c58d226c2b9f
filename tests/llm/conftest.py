import pytest
from pyspark.sql import types as T

#: Texts that every operator must take: null, empty, blank, tied, repeated, long, not Latin, and broken layouts.
EDGE_TEXTS = [
    None, "", " ", "\n\n\t", "a", "a b c", "one two three four five six seven", "one two three four five six seven",
    "Ünïcödé     mixed \x1c separators \x85 here", "日本語 テキスト です", "x" * 5000, "word " * 2000, "\r\nline\r\nline\n\nline",
    "emoji 😀😀 and é combining", "12 34 56", ".,;:!?",
]


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Edge texts under the columns of documents, with null ids and languages and columns of clashing names."""
    names = ["chunk", "bucket", "doc", "ids", "payload", "spans", "n", "count", "line", "kind", "set", "block", "id", "class", "position"]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    rows = [(i, t, None if i % 5 == 0 else ["en", "de"][i % 2], None if i % 4 == 0 else "hot", None if t is None else len(t), *["clash"] * len(names)) for i, t in enumerate(EDGE_TEXTS)]
    rows.append((None, "a null id", None, None, None, *[None] * len(names)))
    return spark.createDataFrame(rows, T.StructType(fields + [T.StructField(n, T.StringType()) for n in names]))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
