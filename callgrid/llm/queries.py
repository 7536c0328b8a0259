"""The registered queries of the subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callgrid.llm import bpe, fingerprint, langid, linededup, lmscore, minhash, packing, quality, secrets, urlfilter
from callgrid.llm.common import load


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(load(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.block_list(pages))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, whole_runs=True)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(load(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(load(spark, sf_dir, "documents")).drop("spans")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(load(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash": op1_minhash, "op2_fingerprint": op2_fingerprint, "op3_url_filter": op3_url_filter, "op4_bpe": op4_bpe, "op5_secret_scan": op5_secret_scan, "op6_line_dedup": op6_line_dedup, "op7_lm_score": op7_lm_score, "op8_language_id": op8_language_id, "op9_best_fit_packing": op9_best_fit_packing, "op10_quality_rules": op10_quality_rules}
ORACLES = {"op1_minhash": minhash.ORACLE, "op3_url_filter": urlfilter.ORACLE, "op10_quality_rules": quality.ORACLE}
