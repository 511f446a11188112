"""The registered queries of the llm operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import oracles
from spanlake.llm.alignment import cross_tokenizer
from spanlake.llm.common import table
from spanlake.llm.decontaminate import contaminated
from spanlake.llm.hardnegatives import RELABELLED, hard_negatives
from spanlake.llm.langid import language_id
from spanlake.llm.language_model import lm_scores
from spanlake.llm.minhash import near_duplicates
from spanlake.llm.mixing import mix
from spanlake.llm.neighbours import nearest
from spanlake.llm.pii import digest, find_pii
from spanlake.llm.tokens import section_tokens
from spanlake.llm.toxicity import toxicity
from spanlake.llm.urlfilter import judge_urls
from spanlake.llm.warc import captures, resolve_revisits


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return found.selectExpr("record_id", "url_key", "ts", "response_id", "outcome", "headers['etag'] AS etag", "headers['date'] AS date", "headers['content-type'] AS content_type")


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", RELABELLED)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_toxicity, op3_language_id, op4_warc_revisits, op5_section_tokens, op6_url_filter, op7_mixing, op8_decontamination, op9_pii, op10_neighbours, op11_lm_scores, op12_hard_negatives, op13_cross_tokenizer)
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": oracles.MINHASH,
    "op4_warc_revisits": oracles.WARC,
    "op6_url_filter": oracles.URL_FILTER,
    "op7_mixing": oracles.MIXING,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
