"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlake.llm.common import held_out, pieces

#: A gram packs up to this many code points of 21 bits; 0 stands for a word's edge.
LONGEST = 3


@cache
def _lower_letters() -> np.ndarray:
    """Each code point's own number where it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.uint32)


def grams(texts: list[str]) -> np.ndarray:
    """All packed 1- to 3-grams of the lower-cased words of letters, each word with an edge at both ends."""
    letters = _lower_letters()[np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    x = letters[keep].astype(np.uint64)
    one = x[x != 0]
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = ((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:])[x[1:-1] != 0]
    # a lone letter's three-gram (edge, letter, edge) is kept: it is a whole word
    return np.concatenate((one, two | np.uint64(1 << 63), three))


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(texts), return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def profiles(docs: DataFrame, size: int = 400) -> DataFrame:
    """(lang, gram, rank): each non-null language's `size` most frequent grams, ties to the smaller gram.

    Counts all text of the rows that aren't held out; repeated rows count again, null texts not at all.
    Each task sums per language before the shuffle, so what moves grows with the distinct grams, not
    with the text. Each task also keeps just its own `size` first grams before a language's grams meet.
    """

    def count(batches):
        held: dict[str, list] = {}

        def out(lang):
            k, n = _merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in pieces(batches, 1):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for lo, hi in _slices(texts):
                    held.setdefault(lang, []).append(counted(texts[lo:hi]))
                    if len(held[lang]) > 16:
                        held[lang] = [_merged(held[lang])]
                        if len(held[lang][0][0]) > 1_000_000:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    rows = docs.filter(~held_out()).filter("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    return top.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def _slices(texts: list[str], most: int = 1 << 19):
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    yield begin, len(texts)


def identify(docs: DataFrame, learned: DataFrame, size: int = 400, max_languages: int = 2000) -> DataFrame:
    """`docs` (with a text column) and lang_pred, score of each row.

    A text's `size` most frequent grams (ties to the smaller gram) are held against each profile; a
    gram's distance is how far its rank is out of place, `size` where the profile lacks it. The
    nearest language wins, ties to the first by name; score is 1 - distance / largest distance. Null
    texts, texts without a letter, and all texts where nothing was learnt: `und`, score 0.
    Profiles hold at most size * max_languages rows, which is checked, and go to every task. Columns of
    `docs` that are called lang_pred or score are replaced; ids and repeated rows don't matter.
    """
    found = learned.limit(size * max_languages + 1).toPandas()
    if len(found) > size * max_languages:
        raise ValueError("more languages than max_languages")
    langs = sorted(found["lang"].unique())
    keys = np.unique(found["gram"].to_numpy(np.int64))
    ranks = np.full((len(keys) + 1, len(langs)), -1, np.int32)
    ranks[np.searchsorted(keys, found["gram"].to_numpy(np.int64)), np.searchsorted(langs, found["lang"])] = found["rank"]

    def best(text: str | None) -> tuple[str, float]:
        if not text or not langs:
            return "und", 0.0
        k, n = counted([text])
        if not len(k):
            return "und", 0.0
        # the packed edges alone (a text without letters) leave no single letters
        top = np.lexsort((k.view(np.int64), -n))[:size]
        k = k[top].view(np.int64)
        at = np.searchsorted(keys, k)
        at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != k)] = len(keys)
        r = ranks[at]
        far = np.where(r < 0, size, np.abs(r - np.arange(len(k))[:, None])).sum(axis=0)
        i = int(far.argmin())
        return langs[i], float(1 - far[i] / (size * len(k)))

    def apply(batches):
        for batch in pieces(batches, at_text):
            got = [best(t) for t in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    at_text = kept.columns.index("text")
    return kept.mapInArrow(apply, StructType([*kept.schema, *StructType.fromDDL("lang_pred string, score double")]))


def language_id(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles from the rows not held out, then every row."""
    scored = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), profiles(docs, size), size)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
