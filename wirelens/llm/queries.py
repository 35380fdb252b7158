"""The registered queries of this subpackage: name -> (Spark query, DuckDB answer or None)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, html, language_model, licenses, merkle, mixing, quality, secrets, sharding, simhash, substrings, suffixes, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether it is kept by the log-likelihood ratio to labelled text."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "toxicity")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere, removed from every document."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the style tree of its site."""
    return html.extract_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document's sentences speak of."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 1, 2, 3 takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, sixteen shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component of fingerprints within four bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier elsewhere, removed from every document."""
    found = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds, found in a latent space and checked word by word."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the n-gram automaton, six parts in seven of them learned from."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, witness hash and verdict of every document in the manifest of all."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the sixteen leading eigenvectors of the covariance, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: those of three patterns, and incompressible strings near sensitive words."""
    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS), F.sha2(told(of(*secrets.KINDS[:-1])), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_substring_dedup": (op2_substring_dedup, None),
    "op3_html_extraction": (op3_html_extraction, None),
    "op4_license_scan": (op4_license_scan, licenses.answer()),
    "op5_mixing": (op5_mixing, None),
    "op6_sharding": (op6_sharding, None),
    "op7_simhash_near_dedup": (op7_simhash_near_dedup, None),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op9_benchmark_decontamination": (op9_benchmark_decontamination, None),
    "op10_language_model": (op10_language_model, None),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle.answer()),
    "op12_embedding_whitening": (op12_embedding_whitening, None),
    "op13_secret_scan": (op13_secret_scan, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
