"""A corpus pipeline: language ID, near-duplicates, decontamination, PII, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import cut, deleted, table, without, written
from spanlake.llm.decontaminate import contaminated
from spanlake.llm.langid import identify, profiles
from spanlake.llm.minhash import near_duplicates
from spanlake.llm.mixing import mix
from spanlake.llm.pii import redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids that occur with several texts go to every task up to this many, and are joined beyond.
MOST_REPEATED = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null texts and those without a letter) go; a null lang is predicted.

    Null ids and repeated rows are documents like others; other columns than those of documents go.
    """
    kept = identify(docs.select(*COLUMNS), profiles(docs)).filter("lang_pred <> 'und'")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` and a `key` for each different text of each doc_id, so that every row can be told and kept.

    That is the doc_id, but for null ids and for all but one of the texts (the one of the smallest hash)
    that share an id: their key is a hash of both, from 2**62 on. Rows of the same id and text share a key.
    """
    mark = F.xxhash64("doc_id", "text")
    several = docs.filter("doc_id is not null").select("doc_id", mark.alias("h")).groupBy("doc_id").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    several = cut(several.filter("first <> last").select("doc_id", "first"))
    several = F.broadcast(several) if several.count() <= MOST_REPEATED else several
    own = F.col("doc_id").isNotNull() & (mark == F.coalesce("first", mark))
    hashed = F.pmod(mark, F.lit(1 << 62)) + F.lit(1 << 62)
    return docs.join(several, "doc_id", "left").withColumn("key", F.when(own, F.col("doc_id").cast("long")).otherwise(hashed)).drop("first")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Null ids come after all others, and different texts of one id are different documents (see `keyed`).
    Of rows that repeat id and text the first by lang, source and n_chars stays. Texts without words stay.
    """
    docs = keyed(docs.select(*COLUMNS))
    found = near_duplicates(docs.select(F.col("key").alias("doc_id"), "text"))
    verdicts = cut(found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")))
    kept = without(docs, "key", verdicts.filter("not kept").select(F.col("doc_id").alias("key")))
    again = verdicts.filter("kept and n > 1").select(F.col("doc_id").alias("key"))
    single = without(kept, "key", again).select(*COLUMNS)
    copies = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars")).alias("m"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return single.unionByName(copies.select("doc_id", "text", "m.*").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or half of one, go; all others stay, null ids and repeated rows too."""
    docs = keyed(docs.select(*COLUMNS))
    bad = contaminated(docs.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, "key", bad.select(F.col("doc_id").alias("key")).distinct()).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; every row stays, whatever its id."""
    return redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents selected to the target weights, with their epoch, tokens taken and the text so far.

    Null ids are ordered first within equal hashes, repeated rows are separate documents.
    """
    return mix(docs, with_text=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("mixing", mix_sources),
]

#: Learnt language profiles and Smith-Waterman alignment have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; what a later stage has replaced is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if last:
            deleted(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
