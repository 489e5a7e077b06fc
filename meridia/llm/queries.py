"""The contracts' queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, chat, decontaminate, license, lm, neardup, pii, quality, sharding, urls
from meridia.session import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return decontaminate.digest(decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_read(spark, sf_dir, "pages"), urls.rules_table(spark))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(_read(spark, sf_dir, "conversations")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lm.scored(docs, lm.fit(docs))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(_documents(spark, sf_dir))
    return found.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in pii.KINDS])


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_minhash_near_dedup, op3_url_filters, op4_chat_formatting, op5_license_scans, op6_sharding, op7_quality_rules, op8_lm_scoring, op9_byte_bpe, op10_pii)}
