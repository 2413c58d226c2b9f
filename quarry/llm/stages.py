"""Stages of the corpus pipeline: each takes and (but for the last) returns the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .source_mix import temperature_mix

#: A text whose best language has less than this probability, or takes more bits a byte (8: as long as random bytes), is in no known language.
LEAST_SCORE, MOST_BITS = 0.5, 7.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those in none of the languages that ``lang`` names."""
    scored = language_id.identify(docs, language_id.fit_on_documents(docs), lang_col="pipeline_lang", score_col="pipeline_score", rate_col="pipeline_bits")
    kept = scored.where((F.col("pipeline_lang") != language_id.UNKNOWN) & (F.col("pipeline_score") >= LEAST_SCORE) & (F.col("pipeline_bits") <= MOST_BITS))
    return kept.select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines within one edit of an earlier line; a document that loses all it has goes.

    Null, empty and blank texts lose no line and stay as they are. Repeated rows have one result. An empty table gives no rows.
    """
    out = line_dedup(docs, kept_col="pipeline_text", lines_col="pipeline_lines", removed_col="pipeline_removed")
    left = F.trim("pipeline_text", F.lit(" \t\r\n\v\f")) != ""
    out = out.where((F.col("pipeline_removed") == 0) | left)
    changed = {"text": F.col("pipeline_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("pipeline_removed") == 0, F.col("n_chars")).otherwise(F.char_length("pipeline_text").cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changed).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the document of smallest id.

    Repeated rows leave one. Documents without words are no one's duplicates. A document without an id goes
    only if it is like one with an id.
    """
    found = ngram_join(docs.select("doc_id", "text"), shingle=5, percent=80, component_col="component")
    first = found.where("doc_id is null and component is null or doc_id = component").select(F.col("doc_id").alias("first")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["first"]), "left_semi")
    text = F.xxhash64("text")
    return kept.withColumn("pipeline_text", text).dropDuplicates(["doc_id", "pipeline_text"]).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are gone through up to twice, the largest once; no document is lost.

    Documents with a null source are a source of their own. Null, empty and blank texts have no tokens and stand where
    their block does. Repeated rows count each and go together. An empty table gives no rows.
    """
    return temperature_mix(docs, max_repeats=2.0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): each document's ids, and the digest of what they decode to.

    Null and empty texts have no ids and decode to nothing; repeated rows are alike. An empty table gives no rows.
    """
    ranks = byte_bpe.load_ranks(spark, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = byte_bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded_col="streamed").drop("text")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("streamed", "UTF-8"), 256).alias("decoded_sha256"))
