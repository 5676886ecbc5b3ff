"""A corpus from raw documents to tokens, in stages that each work on all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, ngram_join, quality, secrets
from millrace.llm.common import drop, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject are gone; null and empty texts are among them. Odd rows as keep_good() has them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies, the document with the least id stays. Odd rows as one_of_each() has them."""
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked; widely copied examples stay. Odd rows as masked() has them."""
    return secrets.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's target weight has them repeated, or are not taken. Odd rows as mixed() has them."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table stays empty; other columns play no part.
    """
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.round_trip(docs, path, pattern)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Certified cutoffs, components of similarity links and BPE merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. A stage's table goes once the next one is written, or fails; the last stage's input stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        try:
            docs = stage(spark, docs, sf_dir)
            if i == len(STAGES) - 1:
                return docs
            docs = written(docs, "stage")
        except BaseException:
            if before:
                drop(before)
            raise
        if before:
            drop(before)
        before = docs
    return docs
