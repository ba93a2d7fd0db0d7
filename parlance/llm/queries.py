"""The thin queries of the corpus operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, exact_dedup, licenses, media, mixing, ngram_join, quality, secrets, token_counts, url_lists

#: The vocabulary of the token queries; the file stays where its package has it.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(_table(spark, sf_dir, "documents"))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_lists.with_fetch_day(_table(spark, sf_dir, "pages"))
    judged = url_lists.judge(captures, url_lists.default_changes(spark))
    return judged.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "entry", F.col("listed_on").cast("string").alias("listed_on"), "category", "blocked")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scans(_table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_source_mixing": op2_source_mixing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_media_chunks": op5_media_chunks,
        "op6_url_lists": op6_url_lists,
        "op7_token_counts": op7_token_counts,
        "op8_secret_scans": op8_secret_scans,
        "op9_license_scans": op9_license_scans,
        "op10_quality_classifier": op10_quality_classifier,
    }
