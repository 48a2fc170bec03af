"""The registered queries of this package: one per operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_pairs, contamination, conversations, hard_negatives, language_model, licenses, packing, planes, pseudonyms, quality_classifier, quality_rules, simhash, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op6_byte_bpe")
def _byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pairs.digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op9_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.result(table(spark, folder, "documents"))


@query("op3_decontamination")
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.result(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_subword_lattice")
def _subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.result(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_bit_planes")
def _bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    return planes.result(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_sum_of_squares")
def _sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return packing.result(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_cover_tree", hard_negatives.ORACLE_SQL)
def _cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.result(table(spark, folder, "embeddings"))


@query("op12_branch_and_bound")
def _branch_and_bound(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.result(table(spark, folder, "conversations"))


@query("op5_quality_rules", quality_rules.ORACLE_SQL)
def _quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.result(table(spark, folder, "documents"))


@query("op4_license_scan", licenses.ORACLE_SQL)
def _license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.result(table(spark, folder, "documents"))


@query("op1_url_filters", url_filters.ORACLE_SQL)
def _url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.result(table(spark, folder, "pages"))


@query("op7_nbsvm")
def _nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.result(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_pseudonyms")
def _pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.result(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
