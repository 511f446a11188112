"""Search over code units: TF-IDF, vectors, log patterns, fusion, lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import normalize_hex_route, normalize_route, tokenize
from spanlake.llm.common import hot_keys, spread_join
from spanlake.operators.contains import holders
from spanlake.operators.graph import cut


_SCORES = "query_id long, unit_id long, score double"


def build_tfidf(units: DataFrame, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """postings(unit_id, token, tf) with tf = count / largest count of the unit, token_df(token, df).

    With `queries` (text) only their tokens' postings are made: a unit's largest count comes from its
    sorted tokens in place, and other tokens are dropped before anything is shuffled.
    """
    if queries is None:
        counts = units.select("unit_id", F.explode("tokens").alias("token")).groupBy("unit_id", "token").agg(F.count("*").alias("c"))
        most = counts.groupBy("unit_id").agg(F.max("c").alias("m"))
        postings = counts.join(most, "unit_id").select("unit_id", "token", (F.col("c") / F.col("m")).alias("tf"))
        return postings, counts.groupBy("token").agg(F.count("*").alias("df"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda a, t: F.struct(t.alias("last"), F.when(t == a["last"], a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["most"], F.when(t == a["last"], a["run"] + 1).otherwise(1)).alias("most"))
    most = F.aggregate(F.sort_array("tokens"), start, step, lambda a: a["most"])
    wanted = queries.select(F.explode(tokenize(F.col("text"))).alias("token")).distinct()
    # inside the generator, so that a unit's largest count is made once and not for each token
    pairs = F.arrays_zip(F.col("tokens").alias("token"), F.array_repeat(most, F.size("tokens")).alias("m"))
    rows = units.filter(F.size("tokens") > 0).select("unit_id", F.explode(pairs).alias("e")).select("unit_id", "e.token", "e.m").join(wanted, "token", "left_semi")
    counts = rows.groupBy("unit_id", "token", "m").agg(F.count("*").alias("c"))
    return counts.select("unit_id", "token", (F.col("c") / F.col("m")).alias("tf")), counts.groupBy("token").agg(F.count("*").alias("df"))


def search_tfidf(queries: DataFrame, postings: DataFrame, token_df: DataFrame, n_units: int | Column, k: int = 10) -> DataFrame:
    """query_id, unit_id, score, matched_terms, rank of each (query_id, text)'s k best units with a score > 0.

    A token that a query repeats counts again; idf is ln(N / (1 + df)) and may be negative.
    """
    words = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    n = F.lit(n_units) if isinstance(n_units, int) else n_units
    rated = words.join(token_df, "token").select("query_id", "token", (F.col("times") * F.log(n / (1 + F.col("df")))).alias("w"))
    scores = postings.join(rated, "token").groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("tf") * F.col("w")), 6).alias("score"), F.sort_array(F.collect_set("token")).alias("matched_terms"))
    return _top(scores.filter("score > 0"), k)


def _top(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best_in_cell(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best units of a cell for each of its queries: (query_id, vector), (unit_id, vector) -> query_id, unit_id, score."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for d in {len(v) for v in left["vector"]}:
            q, u = (f[f["vector"].map(len) == d] for f in (left, right))
            if u.empty:
                continue
            x, ids = np.vstack(u["vector"].to_list()).astype(np.float64), u["unit_id"].to_numpy(np.int64)
            for lo in range(0, len(q), 256):
                some = q.iloc[lo : lo + 256]
                s = np.round(np.vstack(some["vector"].to_list()).astype(np.float64) @ x.T, 6)
                bar = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                for i, query in enumerate(some["query_id"]):
                    at = np.flatnonzero((s[i] >= bar[i]) & (s[i] > 0))
                    at = at[np.lexsort((ids[at], -s[i][at]))[:k]]
                    found.append((query, ids[at], s[i][at]))
        return pd.DataFrame({"query_id": np.repeat([p[0] for p in found], [len(p[1]) for p in found]).astype(np.int64), "unit_id": np.concatenate([p[1] for p in found] or [np.zeros(0, np.int64)]), "score": np.concatenate([p[2] for p in found] or [np.zeros(0)])})

    return best


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, side: int = 20_000) -> DataFrame:
    """query_id, unit_id, score, rank: the k largest inner products of each (query_id, vector) with
    (unit_id, vector), positive ones only. Null vectors, and those of another length than a query's, don't count.

    Queries and units are dealt to a grid of cells of about `side` of each. A cell keeps the k best of
    its units for each of its queries; only these are merged.
    """
    asked, held = queries.select("query_id", "vector").filter("vector is not null"), vectors.select("unit_id", "vector").filter("vector is not null")
    columns, rows = (-(-df.count() // side) or 1 for df in (asked, held))
    deal = lambda df, by, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = deal(asked, "query_id", "c", columns, "r", rows).groupBy("r", "c")
    right = deal(held, "unit_id", "r", rows, "c", columns).groupBy("r", "c")
    return _top(left.cogroup(right).applyInPandas(_best_in_cell(k), _SCORES), k)


@dataclass
class VectorIndex:
    """Vectors by the nearest of some centres: rows (list, slice, unit_id, vector), and slices (list, slices)."""

    rows: DataFrame
    slices: DataFrame
    centres: np.ndarray


def _nearest_lists(vectors: list, centres: np.ndarray, many: int) -> np.ndarray:
    """The `many` centres nearest to each vector, nearest first; two million distances are held at once."""
    x, step = np.array(vectors, np.float64), max(1, 2_000_000 // max(1, len(centres)))
    if len(x) > step:
        return np.concatenate([_nearest_lists(x[i : i + step], centres, many) for i in range(0, len(x), step)])
    near = (centres**2).sum(axis=1) - 2 * x @ centres.T
    top = np.argpartition(near, many - 1, axis=1)[:, :many]
    return np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def build_vector_index(vectors: DataFrame, lists: int | None = None, sample: int = 20_000, side: int = 20_000, rounds: int = 8, seed: int = 3) -> VectorIndex:
    """An inverted file over (unit_id, vector), written out once.

    Centres are means of a sample of at most about `sample` vectors (as many as the root of their number, 4,096 at
    most); every vector lies in the list of its nearest centre, vectors of another length than the most common one in a list of
    that length (-1 - length), null ones in none. Lists of more than `side` rows are searched in slices.
    """
    held = vectors.select("unit_id", "vector").filter("vector is not null")
    common = held.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (common["d"], common["count"]) if common else (0, 0)
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < max(1, (1 << 30) * sample // max(1, n))
    own = held.filter(F.size("vector") == d)
    some = own.filter(share).limit(2 * sample).toPandas()["vector"].to_list() or own.limit(sample).toPandas()["vector"].to_list()
    x = np.array(some, np.float64).reshape(len(some), d)
    lists = max(1, min(lists or int(np.ceil(np.sqrt(n))), 4096, len(x)))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds if len(x) else 0):
        nearest = _nearest_lists(x, centres, 1)[:, 0]
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)

    def place(frames):
        for pdf in frames:
            size = pdf["vector"].map(len)
            own = -1 - size.to_numpy(np.int64)
            if (size == d).any() and len(centres):
                own[(size == d).to_numpy()] = _nearest_lists(pdf["vector"][size == d].to_list(), centres, 1)[:, 0]
            yield pdf.assign(list=own)

    kind = held.schema["vector"].dataType.simpleString()
    placed = cut(held.mapInPandas(place, f"unit_id long, vector {kind}, list long"))
    slices = cut(placed.groupBy("list").agg(F.ceil(F.count("*") / side).alias("slices")))
    rows = placed.join(F.broadcast(slices), "list").withColumn("slice", F.pmod(F.xxhash64("unit_id"), F.col("slices")))
    return VectorIndex(rows.select("list", "slice", "unit_id", "vector"), slices, centres)


def _exact_by_lists(asked: DataFrame, index: VectorIndex, k: int, side: int) -> DataFrame:
    """The rows of `vector_top_k`, from blocks of queries and slices of lists.

    Each block of a query meets a slice once. A slice is scored only for those queries whose bound for it (the inner product with the
    slice's mean, and the query's length times the slice's radius) reaches the k-th score that the block has so far; slices come by
    the best bound. One block of queries and one slice are held at once.
    """
    slices = index.rows
    groups = -(-asked.count() // side) or 1
    shards = max(1, min(-(-slices.count() // side), 4096))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    left = asked.withColumn("part", deal("query_id", groups)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("part", "shard")
    # whole lists lie together, long ones in slices
    right = slices.withColumn("shard", F.pmod(F.xxhash64("list", "slice"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("part", "shard")
    best = _best_in_cell(k)
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "unit_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def pruned(q: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        found = empty
        for d in {len(v) for v in q["vector"]} if len(q) and len(u) else ():
            asks, held = q[q["vector"].map(len) == d], u[u["vector"].map(len) == d]
            if held.empty:
                continue
            x = np.vstack(asks["vector"].to_list()).astype(np.float64)
            long = np.sqrt((x * x).sum(axis=1))
            cells = [cell for _, cell in held.groupby(["list", "slice"])]
            bounds = np.empty((len(asks), len(cells)))
            for j, cell in enumerate(cells):
                v = np.vstack(cell["vector"].to_list()).astype(np.float64)
                mean = v.mean(axis=0)
                bounds[:, j] = x @ mean + long * np.sqrt(((v - mean) ** 2).sum(axis=1).max())
            bar, mine = np.zeros(len(asks)), empty
            slack = 1e-6 + 1e-9 * np.abs(bounds)  # scores are rounded to six places
            for j in np.argsort(-bounds.max(axis=0)):
                reach = (bounds[:, j] + slack[:, j] >= bar) | ~np.isfinite(bounds[:, j])
                if not reach.any():
                    continue
                both = pd.concat([mine, best(asks[reach], cells[j])]).sort_values(["query_id", "score", "unit_id"], ascending=[True, False, True])
                mine = both[both.groupby("query_id").cumcount() < k]
                full = mine.groupby("query_id")["score"].agg(["size", "min"])
                bar = asks["query_id"].map(full["min"][full["size"] >= k]).fillna(0.0).to_numpy()
            found = pd.concat([found, mine])
        return found

    return _top(left.cogroup(right).applyInPandas(pruned, _SCORES), k)


def vector_top_k_indexed(queries: DataFrame, index: VectorIndex, k: int = 10, recall: float = 0.95, probes: int = 256, lists: int | None = None, side: int = 20_000) -> DataFrame:
    """As `vector_top_k`, but each query looks into its nearest lists only; scores are exact inner products.

    How many lists is measured, unless given: at most `probes` queries are answered exactly, and the lists are as many as
    hold `recall` of what they found. Vectors without structure need nearly all lists. No measured number is sure to hold
    all neighbours of other queries, so a recall of 1 opens each list that may hold one, by its vectors' bounds.
    """
    d, asked = index.centres.shape[1] if len(index.centres) else 0, queries.select("query_id", "vector").filter("vector is not null")
    if recall >= 1 and lists is None:
        return _exact_by_lists(asked, index, k, side)
    if lists is None and len(index.centres):
        some = cut(asked.filter(F.size("vector") == d).orderBy(F.xxhash64("query_id", "vector")).limit(probes))
        true = vector_top_k(some, index.rows, k, side).select("query_id", "unit_id").join(index.rows.select("unit_id", "list"), "unit_id").join(some, "query_id").select("vector", "list").toPandas()
        if len(true):
            order = _nearest_lists(true["vector"].to_list(), index.centres, len(index.centres))
            place = (order == true["list"].to_numpy()[:, None]).argmax(axis=1)
            lists = int(np.quantile(place, recall, method="higher")) + 1
    lists, centres = max(1, min(lists or 1, len(index.centres))), index.centres
    some_rows = max(1, 10_000 // lists)  # no more copies of a vector at once than that

    def route(frames):
        for pdf in frames:
            size = pdf["vector"].map(len)
            other, own = pdf[(size != d) | (not len(centres))], pdf[(size == d) & bool(len(centres))]
            yield other.assign(list=-1 - other["vector"].map(len).to_numpy(np.int64))
            for lo in range(0, len(own), some_rows):
                near = own.iloc[lo : lo + some_rows]
                to = _nearest_lists(near["vector"].to_list(), centres, lists)
                yield near.iloc[np.repeat(np.arange(len(near)), lists)].assign(list=to.ravel())

    kind = asked.schema["vector"].dataType.simpleString()
    groups = -(-asked.count() // side) or 1
    routed = asked.mapInPandas(route, f"query_id long, vector {kind}, list long").join(F.broadcast(index.slices), "list").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    left = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).drop("slices").groupBy("list", "slice", "part")
    right = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("list", "slice", "part")
    return _top(left.cogroup(right).applyInPandas(_best_in_cell(k), _SCORES), k)


def search_log_pattern(queries: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """Units of which a log pattern holds a query's text or lies in it (lower case); the first such
    pattern counts: score = max(0.5, shared words / the query's words).

    Different texts meet different patterns by hashes (see `holders`), both ways. Of the units with the same patterns only the
    k first are met, and equal queries are answered once.
    """
    listed = units.filter(F.size("log_patterns") > 0).select("unit_id", F.transform("log_patterns", F.lower).alias("ps"))
    lists = cut(listed.distinct().withColumn("no", F.row_number().over(Window.partitionBy("ps").orderBy("unit_id"))).filter(F.col("no") <= k).select("unit_id", "ps", F.xxhash64("ps").alias("list")))
    patterns = cut(lists.select("list", F.posexplode("ps").alias("pos", "p")).distinct())
    q = queries.select("query_id", F.lower("text").alias("q")).withColumn("h", F.xxhash64("q"))
    texts, parts = q.filter("q is not null").select("h", "q").dropDuplicates(["h"]), patterns.select("p").distinct()
    inside = holders(texts.select("q"), parts.select("p", F.col("p").alias("t")), "q", "t").select(F.xxhash64("q").alias("h"), "p")
    pairs = cut(inside.union(holders(parts, texts, "p", "q").select("h", "p")).distinct())
    first = pairs.join(patterns, "p").groupBy("h", "list").agg(F.min_by("p", "pos").alias("p"))
    words = lambda c: F.array_distinct(F.split(c, r"\s+"))
    share = F.size(F.array_intersect(words("p"), F.col("w"))) / F.greatest(F.size("w"), F.lit(1))
    rated = cut(first.join(texts.select("h", words("q").alias("w")), "h").select("h", "list", F.greatest(F.lit(0.5), F.round(share, 6)).alias("score")))
    best = _top(rated.join(lists.select("list", "unit_id"), "list").select(F.col("h").alias("query_id"), "unit_id", "score"), k).withColumnRenamed("query_id", "h")
    return q.select("query_id", "h").distinct().join(best, "h").select("query_id", "unit_id", "score", "rank")


def rrf_fuse(hits: list[DataFrame], k: int = 60, top_k: int = 10) -> DataFrame:
    """Sum over the lists of 1 / (k + rank) by (query_id, qualified_name), and the top_k of it.

    A name that a list holds twice adds twice.
    """
    rows = hits[0].select("query_id", "qualified_name", "rank")
    for more in hits[1:]:
        rows = rows.union(more.select("query_id", "qualified_name", "rank"))
    scores = rows.groupBy("query_id", "qualified_name").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def _named(hits: DataFrame, units: DataFrame) -> DataFrame:
    return hits.join(units.select("unit_id", "qualified_name"), "unit_id")


def hybrid_search(queries: DataFrame, units: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10, embed: Callable[[str], Column] | None = None) -> DataFrame:
    """TF-IDF and vector hits, 2k of each, fused; TF-IDF alone without vectors.

    U04: `embed` (a pandas UDF from a text column to an array) makes the vectors that aren't given.
    """
    if embed is not None:
        vectors = units.select("unit_id", embed("body_text").alias("vector")) if vectors is None else vectors
        query_vectors = queries.select("query_id", embed("text").alias("vector")) if query_vectors is None else query_vectors
    postings, df = build_tfidf(units, queries)
    n = units.count()
    if vectors is None or query_vectors is None:
        return _named(search_tfidf(queries, postings, df, n, k), units).select("query_id", "qualified_name", "score", "rank")
    lexical = _named(search_tfidf(queries, postings, df, n, 2 * k), units)
    return rrf_fuse([lexical, _named(vector_top_k(query_vectors, vectors, 2 * k), units)], top_k=k)


# --- S06: lookups. Each takes queries (query_id, text) and gives (query_id, unit_id, score, rank). -----------


def _first(found: DataFrame, k: int = 1) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    rows = found.groupBy("query_id", "unit_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def name_keys(units: DataFrame) -> DataFrame:
    """unit_id, key: a unit's name and every dotted suffix of its qualified name, so lookups are equi-joins."""
    parts = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return units.select("unit_id", F.explode(F.array_distinct(F.concat(F.array("name"), suffixes))).alias("key"))


def lookup_name(queries: DataFrame, units: DataFrame, k: int = 1) -> DataFrame:
    """By name, qualified name or its dotted end; the first unit."""
    return _first(queries.join(name_keys(units), F.col("text") == F.col("key")).select("query_id", "unit_id", F.lit(1.0).alias("score")), k)


def _routes(units: DataFrame) -> DataFrame:
    path = F.when(F.col("route_path").contains(" "), F.substring_index("route_path", " ", -1)).otherwise(F.col("route_path"))
    return units.filter("route_path is not null and route_path <> ''").select("unit_id", "route_path", path.alias("route"))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def _route_keys(routes: DataFrame, k: int, **kinds: Column) -> DataFrame:
    """key, unit_id: the k first units under each key, a kind's name before its text, and under `open:` each route with
    parameters as its pattern: `{}` for these, fixed segments behind `=`.

    Units that share a key get the same score from it, so only the first of them can be among the k best.
    """
    pattern = F.array_join(F.transform(_segments(F.col("route")), lambda s: F.when(s.startswith("{") & s.endswith("}"), "{}").otherwise(F.concat(F.lit("="), s))), "/")
    kinds = kinds | {"open": F.when(F.col("route").contains("{"), pattern)}
    keys = routes.select("unit_id", F.explode(F.array(*(F.concat(F.lit(f"{kind}:"), c) for kind, c in kinds.items()))).alias("key"))
    first = Window.partitionBy("key").orderBy("unit_id")
    return keys.filter("key is not null").distinct().withColumn("no", F.row_number().over(first)).filter(F.col("no") <= k).select("key", "unit_id")


def _pattern_keys(asked: DataFrame, keys: DataFrame, most: int = 10_000) -> DataFrame:
    """query_id, key: the `open:` keys that (query_id, path) may have: its path with parameters where some pattern of as many segments has them."""
    marks = F.transform(F.split(F.expr("substring(key, 6)"), "/"), lambda s: s == "{}")
    masks = cut(keys.filter(F.col("key").startswith("open:")).select(marks.alias("mask")).distinct().select("mask", F.size("mask").alias("n")))
    some = asked.select("query_id", _segments(F.col("path")).alias("s")).withColumn("n", F.size("s"))
    met = some.join(F.broadcast(masks) if masks.count() <= most else masks, "n")
    return met.select("query_id", F.concat(F.lit("open:"), F.array_join(F.zip_with("s", "mask", lambda x, m: F.when(m, "{}").otherwise(F.concat(F.lit("="), x))), "/")).alias("key"))


def lookup_route(queries: DataFrame, units: DataFrame, k: int = 1) -> DataFrame:
    """Query `METHOD /path` or `/path`: the same route (3), the same path (2), a path with parameters (1).

    All by equality: paths meet parameters as the patterns that they fit. Of a route's units only the k first are met.
    """
    keys = cut(_route_keys(_routes(units), k, whole=F.col("route_path"), path=F.col("route")))
    q = queries.withColumn("path", F.substring_index("text", " ", -1)).filter(F.col("path").startswith("/"))
    asked = q.select("query_id", F.explode(F.array(F.concat(F.lit("whole:"), "text"), F.concat(F.lit("path:"), "path"))).alias("key")).union(_pattern_keys(q, keys))
    score = F.when(F.col("key").startswith("whole:"), 3.0).when(F.col("key").startswith("path:"), 2.0).otherwise(1.0)
    return _first(spread_join(cut(asked), keys, ["key"]).select("query_id", "unit_id", score.alias("score")), k)


def lookup_route_fuzzy(queries: DataFrame, units: DataFrame, k: int = 1) -> DataFrame:
    """A request path whose numeric or hex segments are parameters: routes that equal it, end it or match it. Met as in `lookup_route`."""
    keys = cut(_route_keys(_routes(units), k, path=F.col("route")))
    q = queries.filter(F.col("text").startswith("/"))
    q = q.select("query_id", F.explode(F.array_distinct(F.array(normalize_route(F.col("text")), normalize_hex_route(F.col("text"))))).alias("path"))
    pieces = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: F.concat(F.lit("path:/"), F.array_join(F.slice(pieces, i, F.size(pieces)), "/")))
    asked = q.select("query_id", F.explode(ends).alias("key")).union(_pattern_keys(q, keys)).distinct()
    return _first(spread_join(cut(asked), keys, ["key"]).select("query_id", "unit_id", F.lit(1.0).alias("score")), k)


def lookup_body(queries: DataFrame, units: DataFrame, k: int = 3) -> DataFrame:
    """Functions and methods whose body holds the text, in lower case; each different text is looked up once."""
    code = units.filter(F.col("unit_type").contains("function") | (F.col("unit_type") == "method")).select("unit_id", F.lower("body_text").alias("b"))
    asked = cut(queries.select("query_id", F.lower("text").alias("t")))
    best = _first(holders(asked, code, "t", "b").select(F.col("t").alias("query_id"), "unit_id", F.lit(1.0).alias("score")), k)
    return _answered(asked, best.withColumnRenamed("query_id", "t"), k)


def _answered(asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The k best units of each text (t) as those of the (query_id, t) that ask for it."""
    met = spread_join(asked.distinct(), best.drop("rank"), ["t"], hot=hot_keys(asked, ["t"]))
    return _first(met.select("query_id", "unit_id", "score"), k)


def lookup_path(queries: DataFrame, units: DataFrame, k: int = 1000) -> DataFrame:
    """Units of files whose path holds the text; each different text is looked up once."""
    asked = cut(queries.select("query_id", F.lower("text").alias("t")))
    files = units.select("source_file").distinct()
    met = holders(asked, files.withColumn("p", F.lower("source_file")), "t", "p")
    best = _first(met.join(units.select("unit_id", "source_file"), "source_file").select(F.col("t").alias("query_id"), "unit_id", F.lit(1.0).alias("score")), k)
    return _answered(asked, best.withColumnRenamed("query_id", "t"), k)


def lookup_file(queries: DataFrame, units: DataFrame, k: int = 1000) -> DataFrame:
    """Units of exactly this file."""
    return _first(queries.join(units, F.col("text") == F.col("source_file")).select("query_id", "unit_id", F.lit(1.0).alias("score")), k)


def lookup_keywords(queries: DataFrame, units: DataFrame, k: int = 3, often: int = 100) -> DataFrame:
    """Functions by keywords (array column `keywords`, those over 2 characters): 3 for one in the name,
    else 2 in the qualified name, 1.5 in the path, 1 in the body's first 2,000 characters.

    Equal sets of keywords are answered once. A set's best units are among the k best by its words that over `often` units
    have, found once for each different set of such words, and the units that have one of its other words.
    """
    code = units.filter(F.col("unit_type").isin("function", "method", "async_function"))
    code = code.select("unit_id", F.lower("name").alias("n"), F.lower("qualified_name").alias("q"), F.lower("source_file").alias("p"), F.lower(F.substring("body_text", 1, 2000)).alias("b"))
    fields = F.array(*(F.struct(F.lit(points).alias("s"), F.col(c).alias("t")) for points, c in ((3.0, "n"), (2.0, "q"), (1.5, "p"), (1.0, "b"))))
    code = code.select("unit_id", F.explode(fields).alias("f")).select("unit_id", "f.s", "f.t")
    asked = cut(queries.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(F.transform(F.filter("keywords", lambda w: F.length(w) > 2), F.lower)))).alias("t")).filter(F.size("t") > 0))
    words = cut(asked.select("t").distinct().select("t", F.explode("t").alias("w")).groupBy("t", "w").agg(F.count("*").alias("times")))
    hits = cut(holders(words, code, "w", "t").groupBy("unit_id", "w").agg(F.max("s").alias("s")))
    held = hits.groupBy("w").agg(F.count("*").alias("n"))
    words = cut(words.join(held, "w").select("t", "w", "times", (F.col("n") > often).alias("hot")))
    common = words.filter("hot").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("w", "times"))).alias("common"))
    total = F.sum(F.col("times") * F.col("s")).alias("score")
    sets = common.select("common").distinct().select("common", F.explode("common").alias("e")).select("common", "e.*")
    by_unit = hits.join(sets.select("w").distinct(), "w", "left_semi").repartition("unit_id")  # summed where they are
    led = cut(_top(by_unit.join(sets, "w").groupBy(F.col("common").alias("query_id"), "unit_id").agg(total), k).select(F.col("query_id").alias("common"), "unit_id"))
    few = words.filter("not hot").join(hits, "w").select("t", "unit_id").union(common.join(led, "common").select("t", "unit_id")).distinct()
    best = _top(few.join(words, "t").join(hits, ["unit_id", "w"]).groupBy(F.col("t").alias("query_id"), "unit_id").agg(total), k)
    return _top(spread_join(asked, best.withColumnRenamed("query_id", "t").drop("rank"), ["t"]), k).select("query_id", "unit_id", "score", "rank")


# --- S07 ------------------------------------------------------------------------------------------------------


def svd_embeddings(units: DataFrame, d: int = 64, rounds: int = 10, extra: int = 8, seed: int = 1) -> DataFrame:
    """unit_id, vector: L2-normalised TF-IDF rows projected on the d first right singular vectors, and normalised again.

    Tokens in more than max(0.9 N, 2) units are left out; all others count. Signs, and the order of equal
    singular values, are arbitrary. Fewer than d dimensions come back where there are fewer units or tokens. See
    `singular_vectors` for `rounds` and `extra`.
    """
    entries = cut(_weighted(units))
    axes, values = singular_vectors(entries, d, rounds, extra, seed)
    raw = _summed(entries.join(axes, "token"), "unit_id", len(values)).withColumnRenamed("v", "raw")
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select("unit_id", F.transform("raw", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("vector"))


def _weighted(units: DataFrame) -> DataFrame:
    """unit_id, token, w: the units' TF-IDF rows, each of length 1."""
    postings, df = build_tfidf(units)
    n = units.count()
    kept = df.filter(F.col("df") <= max(int(0.9 * n), 2))
    rows = postings.join(kept, "token").select("unit_id", "token", (F.col("tf") * (F.log(F.lit(n) / (1 + F.col("df"))) + 1)).alias("w"))
    size = rows.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return rows.join(size.filter("size > 0"), "unit_id").select("unit_id", "token", (F.col("w") / F.col("size")).alias("w"))


def _summed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, v: the sum of w times the array v, place by place, so that sums are made before the shuffle."""
    sums = rows.groupBy(key).agg(*(F.sum(F.col("w") * F.col("v")[j]).alias(f"c{j}") for j in range(width)))
    return sums.select(key, F.array(*(f"c{j}" for j in range(width))).alias("v"))


def _rotated(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Each row's v times a small matrix."""

    def turn(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(v=list(np.stack(pdf["v"].to_list()) @ matrix))

    return rows.select(key, "v").mapInPandas(turn, rows.select(key, "v").schema)


def _gram(rows: DataFrame) -> np.ndarray:
    """The sum of v v^T over all rows: small, made in the tasks, added up by Spark."""

    def own(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(total.size), "s": total.ravel()})

    sums = rows.select("v").mapInPandas(own, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")
    side = int(len(sums) ** 0.5)
    return sums["s"].to_numpy().reshape(side, side)


def singular_vectors(entries: DataFrame, d: int, rounds: int = 10, extra: int = 8, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(token, v array of d) of the first right singular vectors of the matrix (unit_id, token, w), and the singular values.

    Block subspace iteration: d + `extra` random columns over the tokens are multiplied by A^T A `rounds` times, in
    joins and sums by unit and by token, and made orthonormal each time by their Gram matrix, the only one
    (d + extra numbers to a side) that the driver sees.
    """
    units, tokens = (entries.agg(F.count_distinct(c)).first()[0] for c in ("unit_id", "token"))
    width = min(d + extra, units, tokens)
    if not width:
        return entries.select("token", F.array().cast("array<double>").alias("v")).limit(0), np.zeros(0)

    def drawn(batches):
        for pdf in batches:
            yield pd.DataFrame({"token": pdf["token"], "v": [np.random.default_rng([seed, h & (2**63 - 1)]).standard_normal(width) for h in pdf["h"]]})

    v = entries.select("token").distinct().select("token", F.xxhash64("token").alias("h")).mapInPandas(drawn, "token string, v array<double>")
    for turn in range(rounds + 1):
        v = cut(v)
        values, axes = np.linalg.eigh(_gram(v))
        good = values > max(values.max(), 0) * 1e-12
        v = cut(_rotated(v, "token", axes[:, good] / np.sqrt(values[good])))
        width = int(good.sum())
        ahead = cut(_summed(entries.join(v, "token"), "unit_id", width))
        if turn == rounds:
            break
        v = _summed(entries.join(ahead, "unit_id"), "token", width)
    values, axes = np.linalg.eigh(_gram(ahead))  # of A V: its singular values and how to turn V
    first = np.argsort(-values)[: min(d, width)]
    return _rotated(v, "token", axes[:, first]), np.sqrt(np.maximum(values[first], 0))


# --- S09, S10 ---------------------------------------------------------------------------------------------------


def retrieve(queries: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """Hits of (query_id, text, name?): search on text, before it the unit of exactly that name (score 1)
    unless it is among the hits; query_id, qualified_name, score, rank."""
    hits = hybrid_search(queries, units, k=k)
    if "name" not in queries.columns:
        return hits
    named = _named(lookup_name(queries.select("query_id", F.col("name").alias("text")), units), units)
    fresh = named.join(hits, ["query_id", "qualified_name"], "left_anti").select("query_id", "qualified_name", F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    both = fresh.union(hits.select("query_id", "qualified_name", "score", "rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def retrieve_for_error(errors: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """Errors (query_id, function_name, error, module); a second search, k = 3, on the text before `:`."""
    from spanlake.operators.aggregates import merge_results

    text = F.concat_ws(" ", "function_name", "error", "module")
    first = retrieve(errors.select("query_id", text.alias("text"), F.col("function_name").alias("name")), units, k)
    second = hybrid_search(errors.select("query_id", F.substring_index("error", ":", 1).alias("text")), units, k=3)
    return merge_results(first, second)


def retrieve_for_event(events: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """Events (query_id, function_name, module)."""
    return retrieve(events.select("query_id", F.concat_ws(" ", "function_name", "module").alias("text"), F.col("function_name").alias("name")), units, k)


def retrieve_for_log(logs: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """Log lines (query_id, text): log patterns, and search for those that no pattern meets."""
    met = _named(search_log_pattern(logs, units, k), units).select("query_id", "qualified_name", "score", "rank")
    rest = logs.join(met.select("query_id").distinct(), "query_id", "left_anti")
    return met.unionByName(hybrid_search(rest, units, k=k))


def context_window(hits: DataFrame, units: DataFrame, lines: int = 50) -> DataFrame:
    """query_id, context: the hits as text in order of rank, bodies cut to `lines` lines."""
    code = units.select("qualified_name", "source_file", "start_line", "signature", "docstring", "body_text")
    rows = hits.join(code, "qualified_name")
    body = F.array_join(F.slice(F.split(F.coalesce("body_text", F.lit("")), "\n"), 1, lines), "\n")
    place = F.concat(F.lit("# "), "qualified_name", F.lit(" ("), "source_file", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    text = F.concat_ws("\n", place, "signature", F.nullif(F.substring("docstring", 1, 200), F.lit("")), body)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda e: e["t"]), "\n\n").alias("context"))
