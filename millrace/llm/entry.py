"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, media, mixing, ngram_join, oracles, packing, phrases, quality, runs, secrets, suffix_tree, tokencount, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.spans(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(table(spark, sf_dir, "documents"))


def media_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's columns that SQL can express."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def mixing_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's columns that SQL can express."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's columns that SQL can express."""
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def queries() -> dict[str, Query]:
    """The operators' queries, and companions of those that SQL can express in part."""
    return {f.__name__: f for f in (op1_secret_scans, op2_media_columns, op3_quality_rules, op4_token_counts, op5_byte_bpe, op6_license_scans, op7_mixing, op8_lm_scoring, op9_ngram_jaccard, op10_toxicity, op11_pattern_packing, op12_phrase_collocations, op13_periodic_runs, media_base_columns, mixing_base_columns, lm_base_columns)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are tested against brute force."""
    return {
        "op1_secret_scans": oracles.secrets_sql(), "op3_quality_rules": oracles.quality_sql(), "op6_license_scans": licenses.oracle(), "op9_ngram_jaccard": oracles.jaccard_sql(),
        "op12_phrase_collocations": oracles.phrases_sql(), "op13_periodic_runs": oracles.runs_sql(), "media_base_columns": oracles.media_sql(), "mixing_base_columns": oracles.mixing_sql(), "lm_base_columns": oracles.lm_sql(),
    }
