"""Queries of the corpus operators over the documents, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprint, hamming, langid, lexical, near_dedup, oracles, packing, pii, quality, suffix_dedup, token_counts, toxicity
from .base import among, documents, written


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.compared(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(documents(spark, sf_dir))
    size = F.octet_length("kept").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - size).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out():
    """Rows that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.trained(docs.where(~held_out()))
    return langid.identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    docs = bpe.encoded(documents(spark, sf_dir).select("doc_id", "text"), path)
    docs = bpe.decoded(docs.select("doc_id", "ids"), path)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    some = written(toxicity.sampled(labels), "labels")
    model = toxicity.trained(among(docs, some.select("doc_id")).join(some, "doc_id"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def _plain_of(kind: str):
    return lambda s: (s["kind"] == kind) & ~s["added"]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(documents(spark, sf_dir))
    plain = [F.size(F.filter("spans", _plain_of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    added = F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return out.select("doc_id", *plain, F.sha2(pii.joined("spans", False), 256).alias("base_sha256"), pii.joined("spans", True).alias("spans"), added)


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.pieces(docs, tokenizer("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def op8_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = documents(spark, sf_dir, "embeddings").select("vec_id", hamming.signs("embedding").alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), "vec_id", "code")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = documents(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()
    near = among(docs, good)  # of the texts, only these are shuffled
    return quality.resampled(docs, near.join(good.hint("merge"), "doc_id", "left_semi"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(documents(spark, sf_dir))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.counted(docs, tokenizer("byte_bpe_50k.json"), keep_text=False)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_suffix_dedup, op3_near_dedup, op4_langid, op5_bpe, op6_toxicity, op7_pii, op8_hamming, op9_packing, op10_quality, op11_divergence, op12_lexical, op13_token_counts)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    """The others have no SQL form, or none that is quick on whole tables; tests/llm hold them against brute force."""
    return {"op3_near_dedup": oracles.NEAR_DEDUP, "op8_hamming": oracles.HAMMING, "op11_divergence": oracles.DIVERGENCE, "op12_lexical": oracles.LEXICAL}
