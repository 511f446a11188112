"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import BREAKS, Words, chunks, encoded, held_out

#: log2 of the number of feature slots; weights are broadcast, at most 2**SLOTS * 4 bytes dense.
SLOTS = 20
#: (words, words skipped between): unigrams, bigrams, and pairs with one word left out.
SHAPES = ((1, 0), (2, 0), (2, 1))


def _slots(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shape: (text, slot) of its grams."""
    found = []
    for n, skip in SHAPES:
        owner, whole = w.text_of(n, skip)
        slot = (w.grams(n, skip) >> np.uint64(64 - SLOTS)).astype(np.int64)
        found.append((owner[whole], slot[whole]))
    return found


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct slots."""
    out = []
    for lo, hi in chunks(texts):
        parts = _slots(Words(texts[lo:hi], BREAKS))
        both = np.unique(np.concatenate([(o << SLOTS) | s for o, s in parts]))
        cuts = np.searchsorted(both >> SLOTS, np.arange(hi - lo + 1))
        both = (both & ((1 << SLOTS) - 1)).astype(np.int32)
        out += [both[b:e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


class Ftrl:
    """Weights that stay zero until a slot's summed gradient passes l1; each slot has its own rate."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << SLOTS) + 1), np.zeros((1 << SLOTS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.full(len(z), self.l1)
        if isinstance(i, slice) or i[-1] == 1 << SLOTS:
            l1[-1] = 0  # the intercept
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        i = np.append(slots, 1 << SLOTS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.01) -> DataFrame:
    """(slot, weight) rows, without zeros; slot 2**SLOTS is the intercept.

    Learns from rows of `docs` (doc_id, text) with a 0/1 `labels.toxic` that aren't held out. The fit
    takes at most about `max_rows` labelled documents, whole: where there are more, those of the
    smallest id hashes. Features are made on all executors; the bounded sample is then learnt in one
    task, in a seeded order. A document with two labels counts as toxic; rows that repeat a labelled
    document are learnt as often as they occur. Null ids aren't learnt, null texts teach the intercept only.
    """
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.filter(~held_out())
    there = known.count()
    if there > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / there))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("doc_id", "text", "label")

    def extract(batches):
        for batch in batches:
            f = features(encoded(batch.column(1)))
            ends = np.cumsum([0, *map(len, f)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*f, np.zeros(0, np.int32)])))], names=["doc_id", "label", "slots"])

    def fit(batches):
        rows = []
        for batch in batches:
            slots = batch.column(2)
            rows += [(d, y, slots[i].values.to_numpy()) for i, (d, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
        rows.sort(key=lambda r: (r[0], len(r[2])))
        model = Ftrl(alpha, beta, l1, l2)
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(rows)):
                model.learn(rows[i][2], rows[i][1])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["slot", "weight"])

    return rows.mapInArrow(extract, "doc_id long, label int, slots array<int>").repartition(1).mapInArrow(fit, "slot int, weight double")


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, score of each row of `docs`: the logistic of the summed weights of its distinct slots.

    Null and empty texts get the intercept's score. Weights are at most 2**SLOTS + 1 rows by
    construction; L1 leaves far fewer, so they are gathered and sent to the tasks.
    """
    found = weights.toArrow()
    slot, weight = (found.column(i).to_numpy() for i in (0, 1))

    def apply(batches):
        dense = np.zeros((1 << SLOTS) + 1)
        dense[slot] = weight
        used = dense != 0
        for batch in batches:
            texts = encoded(batch.column(1))
            total = np.full(len(texts), dense[-1])
            for lo, hi in chunks(texts):
                parts = [(o[m] << SLOTS) | s[m] for o, s in _slots(Words(texts[lo:hi], BREAKS)) for m in [used[s]]]
                hits = np.unique(np.concatenate(parts))
                total[lo:hi] += np.bincount(hits >> SLOTS, dense[hits & ((1 << SLOTS) - 1)], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(apply, docs.select("doc_id").schema.add("score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for each row of `docs`."""
    scored = score(docs, train(docs, labels, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
