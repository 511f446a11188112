"""Hard negatives: rows of other labels whose inner product with an anchor lies in a window below a positive's."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut, stored
from spanlake.llm.covertree import CoverTree, augmented, bounds, exact_products, search

#: Labels of rows whose vec_id is divisible by 7 are the next of ten; components are taken as 256ths.
RELABELLED = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
UNITS = 256
_NONE, _ALL = np.iinfo(np.int64).max, -(1 << 62)
_FOUND = "asked long, window long, score long, vec_id long, h1 long"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, v array<long>, h1, h2 (hashes of v), d; each different row once.

    Rows with a null label or vec_id, a null vector, or any null or non-finite component take no part.
    """
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    v = v.select("vec_id", label.cast("long").alias("label"), F.transform("x", lambda e: F.floor(e * UNITS)).alias("v"))
    return v.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "d": F.size("v")}).dropDuplicates(["vec_id", "label", "h1", "h2"])


def _rows(column) -> np.ndarray:
    """Lists of one length as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column))).astype(np.int64)


def _unpacked(column, d: int) -> np.ndarray:
    """Rows of d longs from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()) or bytes(8), np.int64)[: len(column) * d].reshape(len(column), d)


def _by_length(batch, name: str = "v"):
    """(row numbers, vectors) of each length in a batch."""
    sizes = np.array([len(x) // 8 for x in batch.column(name).to_pylist()]) if pa.types.is_binary(batch.column(name).type) else batch.column(name).value_lengths().to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, _rows(batch.column(name).take(pa.array(at)))


class Roots:
    """The top of the cover tree: at most `most` centres from a bounded sample, spread by farthest-first choice."""

    def __init__(self, x: np.ndarray, most: int, norm: float):
        y = augmented(x, norm)
        chosen, far = [0], np.linalg.norm(y - y[0], axis=1)
        while len(chosen) < most and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(y - y[chosen[-1]], axis=1))
        self.x, self.y, self.norm, self.radius = x[chosen], y[chosen], norm, np.zeros(len(chosen))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centre, and its distance."""
        y = augmented(x, self.norm)
        nearest = (y @ self.y.T).argmax(axis=1)
        return nearest, np.linalg.norm(y - self.y[nearest], axis=1)


def _kth(scores: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th greatest fitting score, or _ALL if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _ALL)
    return -np.partition(np.where(fit, -scores, -_ALL), k - 1, axis=1)[:, k - 1]


def hard_negatives(
    vectors: DataFrame, anchors: str | Column, label: str | Column = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    block: int = 50_000, tasks: int = 32, sample: int = 4096, group: int = 20_000,
) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding, label) where the condition `anchors` holds: its first
    `positives` other rows of the same label, and for each the first `negatives` rows of other labels with
    least * positive_score <= 100 * score <= most * positive_score (percent, 0 < least <= most): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x); scores are integer inner products (longs, which wrap beyond 2**63);
    higher ones come first, ties by smaller vec_id. Rows with a null label, vec_id or vector, or any null or
    non-finite component take no part. Only vectors of one length have an inner product; each length is
    searched by itself. Rows that repeat id, label and components are one; rows of one id that differ
    are different rows. Other columns are ignored; an empty table gives no rows.

    Of rows with equal vectors and labels the positives + 1 of smallest ids are kept, all that any answer
    can need. The rows are dealt out by the nearest of the cover tree's root centres (at most 4,096, from a
    sample of `sample` rows), and a cell of more than `block` rows in slices. A task builds the cover tree of
    a slice and answers all anchors whose windows reach into it, `group` at a time. A first bound
    comes from the sample's rows. Both searches, for positives and for negatives, are exact.
    """
    spark = vectors.sparkSession
    label = F.expr(label) if isinstance(label, str) else label
    v = stored(usable(vectors, label))
    keep = positives + 1
    order = Window.partitionBy("h1", "h2", "label").orderBy("vec_id")
    points = v.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= keep).drop("no")
    asking = v.filter(F.expr(anchors) if isinstance(anchors, str) else anchors).select(F.col("vec_id").alias("anchor_id"), "h1", "h2", "label", "v", "d")
    asked = stored(asking.dropDuplicates(["h1", "h2", "label"]).withColumn("asked", F.monotonically_increasing_id()))
    q = asked.count()
    lengths = v.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)).alias("square")).orderBy(F.desc("n"), F.desc("d")).first()
    if q == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    main, n, norm = lengths["d"], lengths["n"], math.sqrt(lengths["square"]) + 1
    block = max(2_000, min(block, math.ceil(n / tasks)))
    share = F.pmod("h2", F.lit(1 << 30)) < max(1, min(1 << 30, (1 << 30) * sample // n))
    some = points.filter((F.col("d") == main) & share).orderBy("h2", "vec_id").limit(2 * sample).select("v", "label").toArrow().combine_chunks()
    if some.num_rows == 0:
        some = points.filter(F.col("d") == main).orderBy("h2", "vec_id").limit(sample).select("v", "label").toArrow().combine_chunks()
    known, known_labels = _rows(some.column("v").combine_chunks()), some.column("label").to_numpy()
    roots = Roots(known, min(math.ceil(n / block), 4096), norm)

    def place(batches):
        for batch in batches:
            cell, far, code = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [b""] * batch.num_rows
            for d, at, x in _by_length(batch):
                if d == main:
                    cell[at], far[at] = roots.place(x)
                else:
                    cell[at] = -1 - d
                for i, row in zip(at.tolist(), x, strict=True):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), pa.array(code, pa.binary()), *(batch.column(c) for c in ("vec_id", "label", "h1"))], names=["cell", "far", "v", "vec_id", "label", "h1"])

    placed = stored(points.select("v", "vec_id", "label", "h1").mapInArrow(place, "cell long, far double, v binary, vec_id long, label long, h1 long"))
    cells = cut(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).withColumn("slices", F.ceil(F.col("n") / block)))
    for r in cells.filter("cell >= 0").collect():  # at most 4,096
        roots.radius[r["cell"]] = r["far"] * (1 + 1e-9)
    groups = math.ceil(q / group)
    in_slice = F.pmod(F.xxhash64("vec_id", "h1"), F.col("slices"))
    indexed = placed.join(F.broadcast(cells.select("cell", "slices")), "cell").withColumn("slice", in_slice).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    indexed = indexed.select("cell", "slice", "part", "v", "vec_id", "label", "h1")

    def found_by(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(asked, v, label, low, high) -> the first k rows of each asked vector and window, from all slices."""

        def route(batches):
            for batch in batches:
                parts = []
                for d, at, x in _by_length(batch):
                    own = batch.column("label").take(pa.array(at)).to_numpy()
                    low, high = (_rows(batch.column(c).take(pa.array(at))) for c in ("low", "high"))
                    floor, cell = np.where(low > high, _NONE, low), np.full((len(at), 1), -1 - d)
                    open_cells = np.ones((len(at), 1), bool)
                    if d == main:
                        score = exact_products(x, known)
                        mine = (own[:, None] == known_labels[None, :]) == same
                        for j in range(low.shape[1]):
                            fit = mine & (score >= low[:, j : j + 1]) & (score <= high[:, j : j + 1])
                            floor[:, j] = np.maximum(floor[:, j], _kth(score, fit, k))
                        y = x.astype(np.float64)
                        least_at, most_at = bounds(y @ roots.x.astype(np.float64).T, np.einsum("ij,ij->i", y, y), norm, roots.radius)
                        open_cells = np.zeros(least_at.shape, bool)
                        for j in range(low.shape[1]):
                            open_cells |= (most_at >= floor[:, j : j + 1]) & (least_at <= high[:, j : j + 1]) & (low[:, j] <= high[:, j])[:, None]
                        cell = np.broadcast_to(np.arange(len(roots.x)), least_at.shape)
                    i, c = np.nonzero(open_cells)
                    parts.append((at[i], cell[i, c], [r.tobytes() for r in x], [r.tobytes() for r in floor], i))
                rows, to = (np.concatenate([p[m] for p in parts]) for m in (0, 1))
                code, floor = (pa.array([p[m][i] for p in parts for i in p[4].tolist()], pa.binary()) for m in (2, 3))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(to), *(batch.column(c).take(rows) for c in ("asked", "label", "low", "high")), code, floor], names=["cell", "asked", "label", "low", "high", "v", "least"])

        def answer(rows, asks):
            if not rows.num_rows or not asks.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("asked", "window", "score", "vec_id", "h1")})
            d = len(rows.column("v")[0].as_py()) // 8
            x, y = (_unpacked(t.column("v"), d) for t in (rows, asks))
            longest = norm if d == main else float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) + 1
            labels, ids, h1 = (rows.column(c).to_numpy() for c in ("label", "vec_id", "h1"))
            low, high = (_rows(asks.column(c).combine_chunks()) for c in ("low", "high"))
            floor = _unpacked(asks.column("least"), low.shape[1])
            ask, window, score, row = search(CoverTree(x, longest), x, labels, ids, y, asks.column("label").to_numpy(), low, high, floor, same, k)
            return pa.table({"asked": asks.column("asked").to_numpy()[ask], "window": window, "score": score, "vec_id": ids[row], "h1": h1[row]})

        routed = asked.select("asked", "label", "v", "low", "high").mapInArrow(route, "cell long, asked long, label long, low array<long>, high array<long>, v binary, least binary")
        routed = routed.join(F.broadcast(cells.select("cell", "slices")), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        routed = routed.withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int")).drop("slices")
        keys = ["cell", "slice", "part"]
        found = indexed.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(answer, _FOUND)
        best = Window.partitionBy("asked", "window").orderBy(F.desc("score"), "vec_id", "h1")
        return found.withColumn("no", F.row_number().over(best)).filter(F.col("no") <= k)

    longs = lambda c: F.array(c.cast("long"))
    near = cut(found_by(asked.withColumns({"low": longs(F.lit(_ALL)), "high": longs(F.lit(-_ALL))}), True, keep))
    each = near.groupBy("asked").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores"))
    exact = lambda p, percent: p.cast("decimal(20,0)") * percent / 100
    low, high = F.transform("scores", lambda p: F.ceil(exact(p, least)).cast("long")), F.transform("scores", lambda p: F.floor(exact(p, most)).cast("long"))
    # every asked vector has as many windows, those beyond its own are empty
    padded = lambda c, empty: F.slice(F.concat(c, F.array_repeat(F.lit(empty).cast("long"), keep)), 1, keep)
    windows = cut(asked.join(each, "asked").withColumns({"low": padded(low, 1), "high": padded(high, 0)}))
    apart = found_by(windows, False, negatives).select("asked", "window", "no", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    mine = asking.join(asked.select("h1", "h2", "label", "asked"), ["h1", "h2", "label"]).select("anchor_id", "asked", F.col("h1").alias("own"))
    others = mine.join(near.select("asked", "score", "vec_id", "h1"), "asked").filter(~((F.col("vec_id") == F.col("anchor_id")) & (F.col("h1") == F.col("own"))))
    turn = Window.partitionBy("anchor_id", "asked").orderBy(F.desc("score"), "vec_id", "h1")
    others = others.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= positives)
    numbered = windows.select("asked", F.posexplode("scores").alias("window", "score"))
    pairs = others.join(numbered, ["asked", "score"]).select("anchor_id", "asked", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(apart, ["asked", "window"]).select("anchor_id", "positive_id", F.col("no").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
