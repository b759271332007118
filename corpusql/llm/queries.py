"""Named queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusql.llm.bpe import token_digests
from corpusql.llm.collocations import COLLOCATIONS_SQL, best_collocations
from corpusql.llm.common import table
from corpusql.llm.html_extract import page_digests
from corpusql.llm.language_id import language_of
from corpusql.llm.line_dedup import line_digests
from corpusql.llm.packing import packed
from corpusql.llm.quality import QUALITY_SQL, quality_digests
from corpusql.llm.resampling import resampled
from corpusql.llm.sharding import shard_digests
from corpusql.llm.simhash import link_digests
from corpusql.llm.substring_dedup import REPEATS_SQL, repeat_digests
from corpusql.llm.toxicity import toxicity_digests
from corpusql.llm.vptree import nearest


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return link_digests(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_of(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_digests(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_digests(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digests(table(spark, folder, "documents"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_digests(table(spark, folder, "pages"))


def op3_vp_tree(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_digests(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return best_collocations(table(spark, folder, "documents"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_vp_tree": op3_vp_tree,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": REPEATS_SQL,
    "op8_quality_rules": QUALITY_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
}
