"""Approximate nearest neighbours along shifted Hilbert curves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut, mixed, stored


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (rows) on the Hilbert curve; bits * dimensions <= 63.

    Skilling's transposition, over all points at once.
    """
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: A key's last bits come from the point's id, so that points of one cell can lie in different blocks.
TIE_BITS = 7
#: Windows beyond this are left to the exact search; it bounds a task's memory.
WIDEST = 50_000


class Curves:
    """Several orderings: each its own orthonormal projection and its own shift of the grid."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits, self.dims = bits, min(dims, d)
        self.axes = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, : self.dims] for _ in range(curves)]
        self.low, self.span = [], []
        for a in self.axes:
            y = sample @ a
            low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
            span = np.maximum(high - low, 1e-9)
            self.low.append(low - rng.random(self.dims) * span)
            self.span.append(2 * span)

    def keys(self, x: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        cells = np.clip((x @ self.axes[curve] - self.low[curve]) / self.span[curve], 0, 1 - 1e-9) * (1 << self.bits)
        ties = mixed(ids.astype(np.uint64)) & np.uint64((1 << TIE_BITS) - 1)
        return (hilbert_keys(cells, self.bits) << TIE_BITS) | ties.astype(np.int64)


class Raised:
    """Vectors with one more coordinate, which makes the largest inner product the smallest distance.

    Points get sqrt(M^2 - |x|^2), with M the largest length; queries are scaled to length M and get 0.
    """

    def __init__(self, most: float):
        self.most = most

    def points(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.most**2 - (x * x).sum(axis=1), 0))[:, None]), axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x * (self.most / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros((len(x), 1))), axis=1)


class Blocks:
    """Where each curve is cut into blocks, and how far a block's edges reach over its cuts.

    Cuts and reaches are quantiles of a sample's sorted keys, so a reach of `window` points is one of
    that many on average; it is taken a fifth wider, and three sample points at least.
    """

    def __init__(self, keys: list[np.ndarray], n: int, window: int, block: int):
        held = len(keys[0])
        reach = math.ceil(1.2 * window * held / n) + 3
        parts = max(1, min(math.ceil(n / max(block, 4 * window)), held // (4 * reach)))
        at = np.arange(1, parts) * held // parts
        self.parts = parts
        self.cuts = [k[at] for k in keys]
        self.low = [k[np.maximum(at - reach, 0)] for k in keys]
        self.high = [k[np.minimum(at + reach, held - 1)] for k in keys]

    def of(self, keys: np.ndarray, curve: int) -> np.ndarray:
        """The block that each key lies in."""
        return np.searchsorted(self.cuts[curve], keys, "right")

    def around(self, keys: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of each key's own block and of those whose edges reach it."""
        own, last = self.of(keys, curve), self.parts - 1
        rows = np.arange(len(keys))
        if not last:
            return rows, own
        before = np.flatnonzero((own > 0) & (keys <= self.high[curve][np.maximum(own - 1, 0)]))
        after = np.flatnonzero((own < last) & (keys >= self.low[curve][np.minimum(own, last - 1)]))
        return np.concatenate((rows, before, after)), np.concatenate((own, own[before] - 1, own[after] + 1))


def _matrix(column) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _table(df: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a bounded number of rows (point, x)."""
    got = df.select("point", "x").toArrow().combine_chunks()
    x = _matrix(got.column("x").combine_chunks()) if got.num_rows else np.zeros((0, d))
    return got.column("point").to_numpy().astype(np.int64), x


def _binary(a: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    ends = np.arange(len(a) + 1, dtype=np.int32) * (a.shape[1] * a.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a))])


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as 16-bit integers and what one of their units is. Sums of their products are exact in double precision."""
    unit = np.abs(x).max(axis=1) / 32767
    return np.round(x / unit[:, None]).astype(np.int16), unit


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` largest scores are, ties to the smaller id."""
    if len(scores) <= most:
        return np.arange(len(scores))
    top = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return top[np.lexsort((ids[top], -scores[top]))[:most]]


def _lists(asked: list[int], near: list[tuple[np.ndarray, np.ndarray]], form=pa.RecordBatch):
    """asked, near (structs of score, back = -point) of each query's candidates."""
    ends = pa.array(np.cumsum([0, *(len(s) for s, _ in near)]).astype(np.int32))
    flat = [np.concatenate([*(x[i] for x in near), np.zeros(0, kind)]) for i, kind in ((0, np.float64), (1, np.int64))]
    pairs = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(-flat[1])], names=["score", "back"])
    return form.from_arrays([pa.array(asked, pa.int64()), pa.ListArray.from_arrays(ends, pairs)], names=["asked", "near"])


_NEAR = "asked long, near array<struct<score:double,back:long>>"


def _merged(lists: DataFrame, most: int) -> DataFrame:
    """(asked, near): each query's `most` best candidates of all its lists, once each."""
    every = lists.groupBy("asked").agg(F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("every"))
    once = F.filter("every", lambda e, i: (i == 0) | (e["back"] != F.get("every", i - 1)["back"]))
    return every.select("asked", F.slice(once, 1, most).alias("near"))


def scanned(points: DataFrame, ids: np.ndarray, x: np.ndarray, most: int) -> DataFrame:
    """The `most` best of all points for a bounded number of queries, which go to every task."""

    def scan(batches):
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            mine, s = batch.column(0).to_numpy(), x @ _matrix(batch.column(1)).T
            for i in range(len(ids)):
                both, who = np.concatenate((held[i][0], s[i])), np.concatenate((held[i][1], mine))
                top = _best(both, who, most)
                held[i] = both[top], who[top]
        yield _lists(ids.tolist(), held)

    return _merged(points.select("point", "x").mapInArrow(scan, _NEAR), most)


def gridded(points: DataFrame, asking: DataFrame, n: int, q: int, most: int, side: int = 20_000) -> DataFrame:
    """The exact search: every query against all points, in cells of about `side` points and `side` queries."""
    rows, columns = max(1, math.ceil(n / side)), max(1, math.ceil(q / side))
    each = lambda own, parts, other, others: (
        F.pmod(F.xxhash64("point"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
    )

    def cell(left, right):
        if not left.num_rows or not right.num_rows:
            return _lists([], [], pa.Table)
        asked, ids = right.column("asked").to_numpy(), left.column("point").to_numpy()
        x, y = _matrix(left.column("x").combine_chunks()), _matrix(right.column("y").combine_chunks())
        near = []
        for lo in range(0, len(y), 256):
            near += [(s[top], ids[top]) for s in y[lo : lo + 256] @ x.T for top in [_best(s, ids, most)]]
        return _lists(asked.tolist(), near, pa.Table)

    left = points.select("point", "x", *each("r", rows, "c", columns))
    right = asking.select(F.col("point").alias("asked"), F.col("x").alias("y"), *each("c", columns, "r", rows))
    return _merged(left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, _NEAR), most)


def reach(far: np.ndarray, n: int, recall: float, least: int = 200, always: int = 50_000) -> int | None:
    """The window that reaches a recall, or None if an exact search is cheaper.

    `far` has, for each curve, how many points lie between some queries and each of their true
    neighbours; `recall` of the smallest of these have to fit into the window, which is `least` at
    least. A query may be compared `always` times; beyond that, not as often as there are points.
    """
    window = max(least, math.ceil(np.quantile(far.min(axis=0), recall, method="higher") * 1.1) + 2)
    return window if window <= WIDEST and 2 * window * len(far) < max(n, always) else None


#: Points beside the first of an id are numbered from here on, over 2**61 numbers.
_OTHERS = -(1 << 62)


def nearest(
    vectors: DataFrame, queries: str | Column, k: int = 20, curves: int = 48, window: int | None = None, recall: float = 0.94,
    dims: int = 8, bits: int = 7, block: int = 20_000, sample: int = 20_000, probes: int = 256, spare: int = 10, seed: int = 11,
) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding) where the condition `queries` holds: its k nearest
    other rows by inner product, as query_id, rank, vec_id, score, query_version; ties to the smaller vec_id.

    Exact search in blocks (`gridded`, all queries by all points) answers instead of the curves where fewer than
    100 points are sampled, where the window would have to be over 50,000 points, and where the measured window
    costs more comparisons than there are points (or 50,000, if there are fewer).

    Rows of one vec_id with different vectors are different rows: each is a candidate, and each that is
    asked has an answer of its own under that query_id; query_version is 0 for the one of the
    smallest hashes and a hash for the others. A row is no candidate for itself, the others of its id are.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
    whose length isn't the most common one (ties to the longer): they have no inner product with the
    others. Fewer candidates give fewer rows; rows that repeat a vec_id with the same vector are one.
    Other columns are ignored; an empty table gives no rows.

    Equal vectors are one point with its k + 1 smallest ids, which is all that any answer can need.
    Points and queries get a key on each of several shifted Hilbert curves, after Raised. Curves are
    cut into blocks by key, where a query is compared with the `window` points to both sides; blocks
    reach that far over their cuts. A curve carries 16-bit codes; the k + 1 + `spare` best of all
    curves are ranked anew by the inner product of the original vectors, summed in order.

    The window is measured, not assumed: for `probes` queries, which are scanned against all points,
    `reach` sees where their true neighbours lie on the curves and takes what `recall` of them need. Where that would cost more than all inner
    products, the queries are searched exactly, in blocks. Boxes, cuts and measured distances
    come from about `sample` points; every point is indexed. A given `window` skips the measurement.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.expr(queries).alias("asks") if isinstance(queries, str) else queries.alias("asks"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    v = v.withColumn("x", F.transform("x", lambda e: e + F.lit(0.0)))
    common = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_version long")
    d = common["d"]
    v = v.filter(F.size("x") == d).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    # keys are costly: a small table is dealt to 64 tasks, a large one to tasks of 100,000 rows
    v = v.repartition(max(min(math.ceil(common["count"] / 2000), 64), math.ceil(common["count"] / 100_000)), "h1", "h2")
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = v.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k + 1)
    points = firsts.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("x", "vec_id").alias("x"))
    asking = v.filter("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    points = _told_apart(stored(points.join(asking.select("h1", "h2", F.lit(True).alias("asks")).distinct(), ["h1", "h2"], "left")))
    squares = F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)
    n, q, most = points.agg(F.count("*"), F.count("asks"), F.sqrt(F.max(squares))).first()
    near = _candidates(points, n, q, d, most, k + 1 + spare, k, curves, window, recall, dims, bits, block, sample, probes, seed)

    pairs = near.select("asked", F.explode("near.back").alias("back")).select("asked", (-F.col("back")).alias("point"))
    both = pairs.join(points.select("point", "ids", F.col("x").alias("y")), "point").join(points.filter("asks").select(F.col("point").alias("asked"), "x"), "asked")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    ids = both.select("asked", "point", "ids", score.alias("score")).select("asked", "score", "point", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "point")
    ids = ids.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= k + 1)
    lists = ids.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("no", "vec_id", "score", "point"))).alias("near"))
    answers = asking.join(points.select("h1", "h2", "point"), ["h1", "h2"]).join(lists, F.col("asked") == F.col("point"))
    others = F.filter("near", lambda e: (e["vec_id"] != F.col("query_id")) | (e["point"] != F.col("point")))
    version = F.when(F.col("point") < _OTHERS + (1 << 61), F.col("point")).otherwise(0).cast("long")
    mine = answers.select("query_id", version.alias("query_version"), F.posexplode(F.slice(others, 1, k)).alias("i", "e"))
    return mine.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "e.vec_id", "e.score", "query_version")


def _told_apart(points: DataFrame) -> DataFrame:
    """`points` with a `point` of its own for each: its `first` id, which also orders ties, but for all but one of
    the vectors (the one of the smallest hashes) that share it: a hash below all usual ids."""
    shared = cut(points.groupBy("first").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("kept")).filter("n > 1").select("first", "kept"))
    shared = F.broadcast(shared) if shared.count() <= 200_000 else shared
    other = F.col("kept").isNotNull() & (F.struct("h1", "h2") != F.col("kept"))
    hashed = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 61)) + _OTHERS
    return points.join(shared, "first", "left").withColumn("point", F.when(other, hashed).otherwise(F.col("first"))).drop("kept", "first")


def _candidates(points, n, q, d, longest, most, k, curves, window, recall, dims, bits, block, sample, probes, seed) -> DataFrame:
    """(asked, near) of each asking point, along the curves or exactly."""
    asking = points.filter("asks")
    share = F.pmod("h1", F.lit(1 << 30)) < max(1, min(1 << 30, (1 << 30) * sample // n))
    ids, x = _table(points.filter(share).limit(2 * sample), d)
    if len(ids) < 100:
        return gridded(points, asking, n, q, most)
    raised = Raised(longest)
    shape = Curves(raised.points(x), curves, dims, bits, seed)
    ask = there = at = np.zeros(0, np.int64)
    y = z = np.zeros((1, d))
    own = np.zeros(1, np.int64)
    if window is None:
        own, y = _table(asking.orderBy("h1", "h2").limit(probes), d)
        true = scanned(points, own, y, k + 1).select("asked", F.explode("near.back").alias("back")).select("asked", (-F.col("back")).alias("point")).filter("asked <> point")
        true = true.join(points.select("point", "x"), "point").toArrow()
        ask, there, z = true.column("asked").to_numpy(), true.column("point").to_numpy(), _matrix(true.column("x").combine_chunks())
        if not len(ask):
            return gridded(points, asking, n, q, most)
        at = np.argsort(own)[np.searchsorted(np.sort(own), ask)]

    def order(batches):
        """Each curve's sorted keys of the sample, and how far the probes' true neighbours lie from them."""
        for batch in batches:
            for c in batch.column(0).to_pylist():
                keys = np.sort(shape.keys(raised.points(x), ids, c))
                far = np.zeros(0)
                if len(at):
                    mine, other = shape.keys(raised.queries(y), own, c)[at], shape.keys(raised.points(z), there, c)
                    far = np.abs(np.searchsorted(keys, mine) - np.searchsorted(keys, other)) * (n / len(keys))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), _binary(keys[None, :]), _binary(far[None, :])], names=["c", "keys", "far"])

    got = sorted(points.sparkSession.range(0, curves, 1, curves).mapInArrow(order, "c long, keys binary, far binary").collect())
    if window is None:
        window = reach(np.array([np.frombuffer(r["far"]) for r in got]), n, recall)
        if window is None:
            return gridded(points, asking, n, q, most)
    keys = [np.frombuffer(r["keys"], np.int64) for r in got]
    blocks = Blocks(keys, n, window, block)

    def place(batches):
        for batch in batches:
            own, x = batch.column("point").to_numpy(), _matrix(batch.column("x"))
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False).astype(bool))
            codes, unit = _codes(x)
            up, ask = raised.points(x), raised.queries(x[asks])
            for c in range(curves):
                rows, parts, keys = [], [], []
                own_keys = shape.keys(up, own, c)
                at, part = blocks.around(own_keys, c)
                rows, parts, keys, is_query = [at], [part], [own_keys[at]], [np.zeros(len(at), bool)]
                if len(asks):
                    asked = shape.keys(ask, own[asks], c)
                    rows, parts, keys, is_query = [*rows, asks], [*parts, blocks.of(asked, c)], [*keys, asked], [*is_query, np.ones(len(asks), bool)]
                at = np.concatenate(rows)
                part = np.concatenate(parts).astype(np.int64) * curves + c
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.concatenate(keys)), pa.array(own[at]), pa.array(np.concatenate(is_query)), pa.array(unit[at]), _binary(codes[at])], names=["part", "key", "point", "query", "unit", "code"]
                )

    def search(block):
        key, point, unit = (block.column(c).to_numpy() for c in ("key", "point", "unit"))
        query = block.column("query").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((query, point, key))
        at, ask = order[~query[order]], np.flatnonzero(query[order])
        code = np.frombuffer(b"".join(block.column("code").to_pylist()), np.int16).reshape(len(key), d)
        own, mine, scale = code[at].astype(np.float64), point[at], unit[at]
        middle = np.cumsum(~query[order])[ask]
        asked, near = [], []
        for lo in range(0, len(ask), 64):
            some, mid = order[ask[lo : lo + 64]], middle[lo : lo + 64]
            b, e = max(0, mid[0] - window), min(len(at), mid[-1] + window)
            s = code[some].astype(np.float64) @ own[b:e].T
            for i, m in enumerate(mid):
                left, right = max(b, m - window), min(e, m + window)
                score = s[i, left - b : right - b] * unit[some[i]] * scale[left:right]
                top = _best(score, mine[left:right], most)
                asked.append(int(point[some[i]]))
                near.append((score[top], mine[left:right][top]))
        return _lists(asked, near, pa.Table)

    placed = points.select("point", F.coalesce("asks", F.lit(False)).alias("asks"), "x").mapInArrow(place, "part long, key long, point long, query boolean, unit double, code binary")
    return cut(_merged(placed.groupBy("part").applyInArrow(search, _NEAR), most))
