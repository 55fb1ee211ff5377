"""The registered queries of the corpus operators. None of them is expressible in SQL
(hash fingerprints, trained models, tokenisers), so tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, decontaminate, dedup_spans, fim, html_text, language, mixing, packing, pii, prefix_trie, quality, simhash, token_counts,
)
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans.op1(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op4(table(spark, sf_dir, "conversations"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op9(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op11(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op12(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_simhash, op3_language, op4_chat, op5_decontaminate, op6_packing,
    op7_quality, op8_token_counts, op9_html_text, op10_pii, op11_mixing, op12_fim, op13_prefix_trie)}
