"""The training-data operators as queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettle.llm import exact_dedup, langid, mixing, near_dedup, packing, quality, scoring, secrets, substring, surrogates
from vettle.llm.common import documents

PII_KEY = "production-key-1"


def vocabulary() -> tuple[str, str, str]:
    """(vocabulary file, ranks file, splitting pattern) of the byte-level BPE."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, name = substring.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", F.col(name["n_removed"]).alias("n_removed"), F.array_join(name["removed"], ",").alias("removed"), "text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.secret_scan(documents(spark, sf_dir)))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, name = surrogates.replace_pii(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return df.select("doc_id", F.col(name["n_entities"]).alias("n_entities"), F.col(name["kinds"]).alias("kinds"), "text")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lm_scores(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    df = langid.identified(docs.select("doc_id", "text"), langid.train(docs))
    return df.select("doc_id", F.coalesce(langid.remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_dedup.near_components(documents(spark, sf_dir))
    return df.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.quality_table(documents(spark, sf_dir))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = exact_dedup.copies_table(documents(spark, sf_dir))
    return df.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_pii_surrogates, op4_lm_scores, op5_packing, op6_language_id, op7_mixing, op8_near_dedup, op9_quality_rules, op10_exact_dedup)}
