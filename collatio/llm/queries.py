"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession

from collatio.llm import decontam, exact_dedup, license_scan, lm_scoring, sentencepiece_codec, sharding, simhash, token_files, toxicity, url_filter
from collatio.llm.common import fresh_path, table

#: Folder of the public tokenizers' files; a parameter, not part of the repository.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "")


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    return importlib.import_module("public_tokenizers").path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.round_trip_digest(docs, tokenizer_path("piece_bpe_32k.model"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "token-files")
    token_files.write(docs, tokenizer_path("word_bpe_49k.json"), path)
    return token_files.read_digest(spark, path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.QUERY_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.self_scores(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_simhash": op7_simhash,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
}
