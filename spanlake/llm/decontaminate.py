"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import Words, combined, cut, encoded, pieces, scratch, spread_join, within

#: log2 of the bits of the gram filter that every task holds: 2 MB, with many grams up to 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 24, 28
#: Items of fewer words match nothing; so many seeds of a passage are asked for, if a passing alignment must keep as many.
LEAST_WORDS, SEEDS = 3, 3
#: Longer items are taken as parts of so many words.
ITEM_WORDS = 4096
MATCH, MISMATCH, GAP = 2, -1, -1


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """The best local alignment of two word sequences: score, matched words, and its [start, end) in b.

    Of equal scores the one with more matches counts, then the one that starts later in b, then the one
    that ends first in a, then in b. Only one row of the table is held: a cell is a number made of its
    score, matches and start. No alignment spans more than 3 * len(a) words of b (n matches pay for
    2 * n gaps), so a longer b is taken in windows of twice that, which overlap by it.
    """
    n, m = len(a), len(b)
    if m > max(6 * n, 1024):
        step = max(3 * n, 512)
        parts = [(lo, *align(a, b[lo : lo + 2 * step])) for lo in range(0, m - step, step)]
        lo, score, matched, begin, end = max(parts, key=lambda p: (p[1], p[2], p[0] + p[3], -p[0] - p[4]))
        return score, matched, lo + begin, lo + end
    bits_b, bits_a = (m + 1).bit_length(), (n + 1).bit_length()
    one, hit = 1 << (bits_a + bits_b), 1 << bits_b
    fresh = np.arange(m + 1, dtype=np.int64)
    slope = np.arange(m + 1, dtype=np.int64) * (-GAP * one)
    row, best, end = fresh, 0, 0
    for word in a:
        new = fresh.copy()
        np.maximum(row[:-1] + np.where(b == word, MATCH * one + hit, MISMATCH * one), row[1:] + GAP * one, out=new[1:])
        np.copyto(new, fresh, where=new < one)
        new = np.maximum.accumulate(new + slope) - slope
        row = np.where(new < one, fresh, new)
        j = int(row.argmax())
        if row[j] >= one and row[j] > best:
            best, end = int(row[j]), j
    return best >> (bits_a + bits_b), (best >> bits_b) & ((1 << bits_a) - 1), best & (hit - 1), end


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position of the first word, and hash of each two words of a text that follow each other or have one word between them."""
    owner = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    found = []
    for far in (1, 2):
        at = np.flatnonzero(owner[far:] == owner[: len(owner) - far]) if len(owner) > far else np.zeros(0, np.int64)
        found.append((owner[at], at - w.bounds[owner[at]], combined([w.hashes[at], w.hashes[at + far]], 7)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class _Filter:
    """Bits of hashed grams, which go to every task: 2**size, at most 2**MOST_FILTER_BITS."""

    def __init__(self, grams: DataFrame, n: int):
        self.size = min(max(FILTER_BITS, (32 * n).bit_length()), MOST_FILTER_BITS)
        # rows of 64 bits: at most 2**22, whatever the input
        slots = grams.select(F.expr(f"shiftrightunsigned(gram, {64 - self.size})").alias("slot"))
        bits = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
        self.words, self.bits = (bits.column(i).to_numpy() for i in (0, 1))

    def tester(self):
        known = np.zeros(1 << (self.size - 6), np.uint64)
        known[self.words] = self.bits.view(np.uint64)

        def test(g: np.ndarray) -> np.ndarray:
            slot = g >> np.uint64(64 - self.size)
            return (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

        return test


def contaminated(docs: DataFrame, benchmark: DataFrame, score_at: float = 0.5) -> DataFrame:
    """Documents that hold (parts of) benchmark items: doc_id, item_id, score, matched, begin, end.

    Words are split at ASCII spaces, A-Z in lower case, and aligned word by word (match 2, mismatch and gap -1);
    score is the alignment's share of the item's own score. The best row for each (doc_id, item_id) with
    score >= score_at (0 to 1) comes back; begin and end count words. Every such alignment is found:

    With n words in the item, k matches and e edits, 2k - e >= 2n * score_at. Of the k - 1 gaps between
    matches that follow each other, those of two or more edits use up 2 edits each, so at least T =
    n * score_at - 1 have one edit at most. There, two words of the item that follow each other, or have one
    word between them, stand in the document in the same way. Call these pairs a position of the item; T of
    its n - 1 positions are hit, so of any n - 1 - T + j positions at least j. The rarest ones, by how often their
    pairs occur in all documents, are the item's seeds, with j = 3, or T if that is less. A passage is a
    candidate where j seeds are hit along diagonals that lie no more than n apart, as those of one
    alignment do. Common phrases are no seeds unless the item has nothing rarer.

    Null ids, null and empty texts and items of fewer than LEAST_WORDS words match nothing. Repeated rows
    give one row; a doc_id or item_id with several texts counts by the best of them. An item of more than
    ITEM_WORDS words is taken as parts of that length, and the best part counts. Other columns are ignored.

    The documents are read three times: to count the items' pairs, to find seeds, and for the texts of candidates, the
    only ones that move. Tasks test pairs against a bit filter (2 to 32 MB, by their number; ORed from the tasks' bits);
    hits meet the seeds in a Spark join over whose tasks frequent seeds are spread. Equal items are one.
    """
    if not 0 < score_at <= 1:
        raise ValueError("score_at is a share")

    def parts(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                w = Words([text])
                rows += [(i, lo // ITEM_WORDS, w.buf[w.starts[lo] : w.ends[min(lo + ITEM_WORDS, len(w.starts)) - 1]].decode("utf-8", "replace")) for lo in range(0, len(w.starts), ITEM_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["item_id", "part", "text"])

    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.mapInArrow(parts, "item_id long, part long, text string").select("item_id", F.xxhash64("text").alias("item"), "text")
    own = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    with scratch(items) as items:
        texts = cut(items.groupBy("item").agg(F.first("text").alias("text")))
        seeds = _rarest(own, texts, score_at)
        near = _candidates(own, seeds)
        scored = _aligned(own, near, texts, score_at)
        best = F.max_by(F.struct("score", "matched", "begin", "end"), F.struct("score", -F.col("begin"), -F.col("end"))).alias("best")
        ids = items.select("item", "item_id").distinct()
        return cut(scored.join(ids, "item").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*"))


def _rarest(docs: DataFrame, texts: DataFrame, score_at: float) -> DataFrame:
    """gram, item, place, words, need: the seeds of each item, see `contaminated`."""

    def item_pairs(batches):
        for batch in batches:
            w = Words(encoded(batch.column(1)))
            owner, at, gram = _pairs(w)
            n = np.diff(w.bounds)[owner]
            keep = n >= LEAST_WORDS
            keys = batch.column(0).take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(at[keep]), pa.array(gram[keep].view(np.int64)), pa.array(n[keep])], names=["item", "place", "gram", "words"])

    pairs = cut(texts.select("item", "text").mapInArrow(item_pairs, "item long, place long, gram long, words long"))
    bits = _Filter(pairs, pairs.count())

    def counted(batches):
        known = bits.tester()
        for batch in pieces(batches, 0):
            gram = _pairs(Words(encoded(batch.column(0))))[2]
            gram, n = np.unique(gram[known(gram)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    often = docs.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    places = pairs.join(often, "gram", "left").groupBy("item", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("often"), F.first("words").alias("words"))
    kept = F.greatest(F.lit(1), F.ceil(F.col("words") * F.lit(str(score_at)).cast("decimal(20,15)")) - 1).cast("long")
    places = places.withColumn("kept", kept).withColumn("need", F.least(F.lit(SEEDS), "kept"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "place"))
    chosen = places.withColumn("rank", rank).filter(F.col("rank") <= F.col("words") - 1 - F.col("kept") + F.col("need")).select("item", "place", "need")
    return cut(pairs.join(chosen, ["item", "place"]))


def _candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, copy, item, low, high: documents and the zones (an item's length each) whose seeds suffice."""
    n, longest, least = seeds.agg(F.count("*"), F.coalesce(F.max("words"), F.lit(0)), F.coalesce(F.min("need"), F.lit(1))).first()
    bits = _Filter(seeds, n)
    lone = seeds.filter("need = 1")
    alone = _Filter(lone, lone.count()) if least == 1 else None

    def hits(batches):
        known, single = bits.tester(), alone.tester() if alone else lambda g: np.zeros(len(g), bool)
        for batch in pieces(batches, 2):
            owner, at, gram = _pairs(Words(encoded(batch.column(2))))
            hit = np.flatnonzero(known(gram))
            hit = hit[np.lexsort((at[hit], owner[hit]))]
            owner, at, gram = owner[hit], at[hit], gram[hit]
            # one hit suffices for few items only; others have another within reach
            close = (np.diff(owner) == 0) & (np.diff(at) <= 3 * longest)
            keep = np.concatenate((close, [False])) | np.concatenate(([False], close)) | single(gram) if len(hit) else np.zeros(0, bool)
            row = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(at[keep]), pa.array(gram[keep].view(np.int64))], names=["doc_id", "copy", "at", "gram"])

    with scratch(docs.mapInArrow(hits, "doc_id long, copy long, at long, gram long")) as found:
        met = spread_join(found, seeds, ["gram"]).withColumn("zone", F.floor((F.col("at") - F.col("place")) / F.col("words")))
        met = met.select("doc_id", "copy", "item", "place", "need", F.explode(F.array("zone", F.col("zone") + 1)).alias("zone")).distinct()
        met = met.groupBy("doc_id", "copy", "item", "zone").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need")
        return cut(met.groupBy("doc_id", "copy", "item").agg(F.min("zone").alias("low"), F.max("zone").alias("high")))


def _aligned(docs: DataFrame, near: DataFrame, texts: DataFrame, score_at: float) -> DataFrame:
    """doc_id, item, score, matched, begin, end of the candidates that reach score_at."""
    lists = near.join(texts, "item").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item", "low", "high", "text")).alias("near"))
    key = F.xxhash64("doc_id", "copy")
    held = within(docs.withColumn("key", key), "key", near.select(key.alias("key")).distinct()).drop("key").dropDuplicates(["doc_id", "copy"])

    def score(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, near in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                y = Words([text]).hashes
                items = Words(encoded(pa.array([c["text"] for c in near], pa.string())))
                for i, c in enumerate(near):
                    x = items.hashes[items.bounds[i] : items.bounds[i + 1]]
                    n = len(x)
                    begin = max(0, (c["low"] - 2) * n)
                    part = y[begin : (c["high"] + 3) * n]
                    if np.isin(x, part).sum() < n * score_at:  # fewer words than any passing alignment matches
                        continue
                    s, k, p, q = align(x, part)
                    if s >= score_at * MATCH * n:
                        rows.append((doc, c["item"], s / (MATCH * n), k, p + begin, q + begin))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "item", "score", "matched", "begin", "end"])

    return held.join(lists, ["doc_id", "copy"]).select("doc_id", "text", "near").mapInArrow(score, "doc_id long, item long, score double, matched long, begin long, end long")
