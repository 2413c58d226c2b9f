"""Thin queries over the operators: each reads its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, media_columns, pii, secret_scan, toxicity
from .exact_topk import exact_topk
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .oracles import SQL
from .source_mix import temperature_mix
from .substring_dedup import substring_dedup
from .turn_repair import digests, repair_turns
from .vector_codes import errors_by_label, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temperature_mix(_documents(spark, sf_dir).select("doc_id", "source", "text"), max_repeats=2.0)
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block"), "mix_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir).select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_columns.text_to_media(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    out = media_columns.media_features(stored)
    length = F.octet_length("payload").cast("long")
    return out.select(
        "doc_id", "n_bytes", length.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.lower(F.hex("low_frequency")).alias("feature"), "error",
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir).select("doc_id", "text"), shingle=4, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text"), spans_col="found")
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])],
        F.sha2(secret_scan.as_text(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.as_text(F.col("secret_spans")).alias("spans"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit_on_documents(docs)
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(spark, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = byte_bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, bytes_col="decoded", decoded_col="streamed").drop("text")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.char_length("streamed").cast("long").alias("decoded_chars"),
    )


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of ``conv_id:turn``: dropped, emptied, without ends of sentences, repeated, said by the user."""
    space = F.lit(" ")
    key = F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])), F.lit(20))
    rows = turns.select("conv_id", "turn", key.alias("fault"), *[F.coalesce(c, space).alias(c) for c in ("role", "text")]).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    script, counts = repair_turns(damaged_turns(turns))
    out = turns.select("conv_id").distinct()
    for found in (counts, digests(script)):
        out = out.join(found, out["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *whole, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return errors_by_label(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "text", toxicity.held_out().alias("held_out"))
    return toxicity.classify(rows, model).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_media_columns": op3_media_columns,
        "op4_exact_topk": op4_exact_topk,
        "op5_ngram_join": op5_ngram_join,
        "op6_line_dedup": op6_line_dedup,
        "op7_pii": op7_pii,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_id": op10_language_id,
        "op11_turn_repair": op11_turn_repair,
        "op12_vector_codes": op12_vector_codes,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
