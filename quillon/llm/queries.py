"""The queries of this subpackage, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, bpe, embed_dedup, jaccard_join, langid, license_scan, merkle, packing, quality_crf, quality_rules, secret_scan, toxicity, whitening
from quillon.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", "stratum", *counts, "base_failed", F.array_join("rules_failed", ",").alias("rules_failed"), "risk", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, ["doc_id"])
    decoded = bpe.decode(encoded, path, ["doc_id", "n_tokens", "ids"])
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, where=fold("doc_id", 3) != 1)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_crf.learn(docs, labels, where=fold("doc_id", 4) != 2)
    return quality_crf.score(docs, model, ["doc_id"]).select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.learn(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, where=fold("doc_id", 4) != 2)
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _held_out(k: int, r: int):
    return F.coalesce(fold("doc_id", k) == r, F.lit(False)).alias("held_out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [
        op1_quality_rules, op2_byte_bpe, op3_embedding_near_dedup, op4_language_id, op5_quality_classifier, op6_ngram_jaccard_join,
        op7_best_fit_packing, op8_secret_scans, op9_toxicity, op10_license_scans,
        op11_embedding_whitening, op12_nearest_neighbours, op13_merkle_manifest,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests/llm holds the others against brute force, round trips and held-out accuracy."""
    return {
        "op1_quality_rules": quality_rules.oracle(), "op3_embedding_near_dedup": embed_dedup.oracle(), "op6_ngram_jaccard_join": jaccard_join.oracle(), "op8_secret_scans": secret_scan.oracle(),
        "op10_license_scans": license_scan.oracle(), "op12_nearest_neighbours": ann.oracle(), "op13_merkle_manifest": merkle.oracle(),
    }
