"""Queries over the corpus operators, one for each, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gam, grammar, media, mixing, pseudonyms, ratio, repeats, simhash, transducer
from .common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.written_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.judged(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_rows(documents(spark, sf_dir), pseudonyms.key_of(spark, pseudonyms.OPEN_KEY))


def op5_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))


def op7_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(documents(spark, sf_dir))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_removed(documents(spark, sf_dir))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_repair_ids, op2_ngram_ratio, op3_gam_quality, op4_feistel_pii, op5_transducer_counts, op6_curriculum_mix, op7_media_archive, op8_repeated_strings, op9_simhash_groups, op10_bpe_round_trip)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """None of these operators has a whole oracle in SQL: tests/llm holds each against a brute-force version."""
    return {}
