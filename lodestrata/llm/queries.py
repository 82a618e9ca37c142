"""The queries of this subpackage's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, importance, language, lines, media, minhash, mixing, packing, phrases, repeats, rules, toxicity, warc
from .shared import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony_digests(documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    return warc.read_archives(archives, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(documents(spark, sf_dir))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir)).drop("k")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_frequency, op2_telephony_audio, op3_best_fit_packing, op4_suffix_sort_dedup, op5_warc, op6_mixing, op7_circulant_minhash, op8_language_id, op9_importance_resampling, op10_toxicity, op11_token_alignment, op12_collocations, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.ORACLE, "op12_collocations": phrases.ORACLE, "op13_line_dedup": lines.ORACLE}
