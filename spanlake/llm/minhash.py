"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import Words, chunks, combined, cut, encoded, hot_keys, mixed, packed, pieces, scratch, spread_join, within
from spanlake.llm.components import connected_components

#: Coordinates of a signature; the lowest bit of each makes the sketch. At least bands * rows.
BITS = 2048
#: Sets of up to so many shingles have their signature over 2**16 places; each further tier is for 64
#: times larger sets and has 64 times the places, and from the third one on all 2**64 hashes are places.
#: So two unlike sets fall on few places in common, whatever their size.
TIER = 4096


def tiers(n: int, percent: int) -> list[int]:
    """The tiers of a set of n shingles: its own, and the next if a set similar enough can lie there."""
    own = 0
    while n > TIER << (6 * own) and own < 2:
        own += 1
    return [own, own + 1] if own < 2 and 100 * n >= percent * (TIER << (6 * own)) else [own]


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; a short text is one shingle, an empty one none."""
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        grams = w.grams(words)
        for b, e in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            if e - b >= words:
                yield np.unique(grams[b : e - words + 1])
            elif e > b:
                yield combined([w.hashes[i : i + 1] for i in range(b, e)], e - b)
            else:
                yield grams[:0]


@cache
def _tables(tier: int, seed: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of a tier's places; the second one as a window of `length` values for each place."""
    places, kind = 1 << (16 + 6 * tier), np.uint16 if tier == 0 else np.uint32
    rng = np.random.default_rng(seed + tier)
    scatter, second = rng.permutation(places).astype(kind), rng.permutation(places).astype(kind)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[:length])), length)


class Circulant:
    """Signatures from two permutations, the second one shifted by 1, 2, ... places.

    A shingle falls on one of a tier's places; the first permutation scatters the places, and
    coordinate k is the smallest value that the second permutation, shifted by k, gives to a place
    of the set. A place's values at all shifts lie side by side, so one shingle costs one short copy.
    The last tier's permutations are bijective scramblings of 64-bit hashes in place of tables.
    """

    def __init__(self, bands: int, rows: int, seed: int, length: int = 0):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.seed, self.length = bands, rows, seed, max(length, bands * rows)
        self.weights = rng.integers(1, 1 << 63, rows, np.uint64) | np.uint64(1)
        self.salts = mixed(np.arange(1, 3 * bands + 1, dtype=np.uint64)).reshape(3, bands)

    def signature(self, hashes: np.ndarray, tier: int = 0) -> np.ndarray:
        if tier > 1:
            places, shifts = mixed(hashes + np.uint64(self.seed)), np.arange(self.length, dtype=np.uint64)
            out = np.full(self.length, np.uint64(2**64 - 1))
            for i in range(0, len(places), 256):
                np.minimum(out, mixed(places[i : i + 256, None] + shifts).min(axis=0), out=out)
            return out
        scatter, shifted = _tables(tier, self.seed, self.length)
        places = scatter[(hashes & np.uint64(len(scatter) - 1)).astype(np.int64)]
        out = shifted[places[:256]].min(axis=0)
        for i in range(256, len(places), 256):
            np.minimum(out, shifted[places[i : i + 256]].min(axis=0), out=out)
        return out

    def keys(self, signatures: np.ndarray, tier: int = 0) -> np.ndarray:
        """A 64-bit key for each band of the first bands * rows coordinates; tier and band are part of it."""
        parts = signatures[:, : self.bands * self.rows].reshape(len(signatures), self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        return mixed(mixed((parts * self.weights).sum(axis=2, dtype=np.uint64)) ^ self.salts[tier])

    @staticmethod
    def sketch(signatures: np.ndarray) -> np.ndarray:
        """The lowest bit of each coordinate."""
        return np.packbits((signatures & signatures.dtype.type(1)).astype(np.uint8), axis=1)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set, as two signed numbers."""
    m = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    f = np.array([m.sum(dtype=np.uint64), mixed(m * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)]).view(np.int64)
    return int(f[0]), int(f[1])


def signatures(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 64, rows: int = 6, seed: int = 7) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, f1, f2 (set fingerprint), tier, sketch, keys.

    A row for each input row and tier of its set; the first of them is marked as `own`.
    """
    schema = "doc_id long, n_shingles long, f1 long, f2 long, own boolean, tier int, sketch array<long>, keys array<long>"

    def sign(batches):
        c = Circulant(bands, rows, seed, BITS)
        for batch in pieces(batches, 1):
            at, n, marks, own, tier, sigs = [], [], [], [], [], []
            for i, s in enumerate(shingle_sets(encoded(batch.column(1)), words)):
                mark = _fingerprint(s) if len(s) else (0, 0)
                for k, t in enumerate(tiers(len(s), percent)):
                    at.append(i)
                    n.append(len(s))
                    marks.append(mark)
                    own.append(k == 0)
                    tier.append(t)
                    sigs.append(c.signature(s, t) if len(s) else np.zeros(BITS, np.uint16))
            sketches, keys = np.zeros((len(at), BITS // 8), np.uint8), np.zeros((len(at), bands), np.uint64)
            for t in set(tier):
                mine = [i for i, u in enumerate(tier) if u == t]
                of_tier = np.stack([sigs[i] for i in mine])
                sketches[mine], keys[mine] = c.sketch(of_tier), c.keys(of_tier, t)
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(x.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.array(own, pa.bool_()), pa.array(tier, pa.int32()), lists(sketches, BITS // 64), lists(keys, bands)],
                names=["doc_id", "n_shingles", "f1", "f2", "own", "tier", "sketch", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, schema)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets have 100 * common >= percent * union.

    `reps` has the fingerprint of the set that counts for each id. A pair takes up the set of b first
    and meets that of a, the hub if there is one, last: a hub's set is sent once for each of the tasks
    that its pairs are split over, not with each pair.
    """

    def sets(batches):
        for batch in pieces(batches, 1):
            found = list(shingle_sets(encoded(batch.column(1)), words))
            marks = [_fingerprint(s) if len(s) else (0, 0) for s in found]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "f1", "f2", "set"])

    pairs = packed(cut(pairs))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = within(texts, "id", ids).mapInArrow(sets, "id long, f1 long, f2 long, set array<long>")
    own = texts.join(reps.withColumnRenamed("doc_id", "id"), ["id", "f1", "f2"], "left_semi").dropDuplicates(["id"])
    with scratch(own.select("id", "set")) as own:
        both = pairs.join(own.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        both = spread_join(both, own.select(F.col("id").alias("a"), F.col("set").alias("x")), ["a"], hot=hot_keys(pairs, ["a"], least=50))
        both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("c"))
        return cut(both.filter(F.expr(f"100 * c >= {percent} * (n + m - c)")).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 64, rows: int = 6, seed: int = 7) -> DataFrame:
    """Groups of documents that links of Jaccard similarity >= percent / 100 hold together.

    Takes doc_id and text (other columns are ignored); returns a row for each input row: doc_id,
    n_shingles, component_id (the smallest id reachable), kept (doc_id = component_id). Null and
    empty texts have no shingles and stand alone; so do rows with a null id, which get a null
    component and kept null. Equal sets are one node from the start, so copies cost nothing more.
    Rows that repeat an id are one document, whose links are those of its text with the smallest set
    fingerprint; n_shingles is each row's own.

    Candidates come in three rounds, each of which only looks at what the earlier ones left in
    different groups: each document with the bucket minimum that it shares most buckets with; each
    document with the first ids of its buckets' smallest and largest groups; and all that still share
    a bucket, pair by pair inside the join, with frequent buckets split over tasks. Pairs have to pass a
    sketch of 2,048 bits first, which turns down most pairs under 0.68 before anything is emitted.
    """
    with scratch(signatures(docs, words, percent, bands, rows, seed)) as sig:
        members = sig.filter("own").select("doc_id", "n_shingles", "f1", "f2")
        chosen = members.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("f")).select("doc_id", "f.f1", "f.f2")
        nodes = chosen.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
        reps = cut(nodes.select(F.col("rep").alias("doc_id"), "f1", "f2"))
        groups = _groups(docs, sig, reps, words, percent)
        by_set = reps.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))
        placed = chosen.join(by_set, ["f1", "f2"]).select("doc_id", "component")
        out = members.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return cut(out.withColumn("kept", F.col("doc_id") == F.col("component_id")))


def _groups(docs: DataFrame, sig: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the representatives that links hold together, in near_duplicates' three rounds."""
    sig = sig.join(reps, ["doc_id", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "tier"]).withColumnRenamed("doc_id", "id")
    with scratch(sig.select("id", "tier", "sketch", "keys")) as sig:
        sketches = sig.select("id", "tier", "sketch")
        buckets = sig.select("id", "tier", F.posexplode("keys").alias("band", "key"))
        hubs = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo")
        with scratch(buckets.join(hubs, "key")) as shared:
            usual = shared.filter("id > lo").groupBy("id", "lo", "tier").count()
            usual = usual.groupBy("id").agg(F.max_by(F.struct("lo", "tier"), F.struct("count", -F.col("lo"), "tier")).alias("hub"))
            first = packed(verified(_sketched(usual.select(F.col("hub.lo").alias("a"), F.col("id").alias("b"), "hub.tier"), sketches, percent), docs, reps, words, percent))

            # each of the buckets that still hold several stars: its ids with the two ends' ids
            open_ = _open(shared.select("key", "tier", "id"), first.select(F.col("b").alias("id"), F.col("a").alias("component")))
            ends = open_.groupBy("key").agg(F.min(F.struct("group", "id")).alias("lo"), F.max(F.struct("group", "id")).alias("hi"))
            spokes = open_.join(ends, "key").select("id", "tier", "group", F.explode(F.array("lo", "hi")).alias("hub")).filter("group <> hub.group")
            spokes = spokes.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"), "tier").distinct()
            more = verified(_sketched(spokes, sketches, percent).distinct(), docs, reps, words, percent)
            groups = packed(cut(connected_components(first.union(more))))

            # a pair is taken up in the first band that it shares, by 31 bits of the earlier bands' keys
            short = sig.select("id", "tier", "sketch", F.expr("transform(keys, k -> cast(k & 2147483647 as int))").alias("bands"))
            with scratch(_open(shared.select("key", "band", "tier", "id"), groups).join(short, ["id", "tier"])) as rest:
                x, y = (rest.select("key", "band", F.col("group").alias(f"g{s}"), F.col("id").alias(s), F.col("sketch").alias(f"k{s}"), F.col("bands").alias(f"b{s}")) for s in "ab")
                once = F.expr("not exists(zip_with(slice(ba, 1, band), slice(bb, 1, band), (p, q) -> p = q), e -> e)")
                pairs = spread_join(x, y.drop("band"), ["key"]).filter("ga < gb").filter(_close("ka", "kb", percent) & once)
                pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                return cut(_bridged(groups, verified(pairs, docs, reps, words, percent)))


def _open(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """The buckets' rows and `group` where the ids lie in more than one group; an id alone is its own group."""
    placed = buckets.join(groups, "id", "left").select(*buckets.columns, F.coalesce("component", "id").alias("group"))
    split = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
    return placed.join(split, "key", "left_semi")


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches are close."""
    both = pairs.join(sketches.toDF("b", "tier", "y"), ["b", "tier"]).join(sketches.toDF("a", "tier", "x"), ["a", "tier"])
    return both.filter(_close("x", "y", percent)).select("a", "b")


def _bridged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) with the components that new links (a, b) hold together made one."""
    at = links.join(groups.toDF("a", "ga"), "a", "left").join(groups.toDF("b", "gb"), "b", "left")
    new = packed(cut(connected_components(at.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))))
    moved = groups.join(new.toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return moved.union(new.join(groups.select("id"), "id", "left_anti"))


def _close(x: str, y: str, percent: int):
    """Whether two sketches differ in no more bits than 4.75 deviations over a pair at the threshold."""
    share = (1 - percent / 100) / 2
    most = int(BITS * share + 4.75 * (BITS * share * (1 - share)) ** 0.5) + 1
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITS // 64)) + f" <= {most}")
