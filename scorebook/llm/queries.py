"""The registered queries: every operator over the whole of its table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.llm import (
    alignment, decontaminate, langid, lines, manifest, mixing, neardup, pii, repetition, sentences, simhash, suffixes, urls,
)
from scorebook.llm.registry import ORACLES, QUERIES, query, table
from scorebook.llm import sql

__all__ = ["ORACLES", "QUERIES"]


@query("op1_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op2_decontamination", sql.DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.find(table(spark, sf_dir, "documents"))


@query("op4_sentence_spans", sql.SENTENCE_SPANS)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.find(table(spark, sf_dir, "documents"))


@query("op5_source_mixing", sql.SOURCE_MIXING)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.find(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op7_repetition_rules", sql.REPETITION)
def repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op8_near_duplicates", sql.NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"))


@query("op9_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup", sql.REPEATED_PASSAGES)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", sql.MANIFEST)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.find(table(spark, sf_dir, "documents"))


@query("op12_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.find(table(spark, sf_dir, "documents"))
