"""Work that once grew with the square of the rows, held to a time that only linear work keeps."""

import os
import random
import threading
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanlake.functions import extract as X
from spanlake.functions.text import normalize_hex_route, normalize_route, route_matches
from spanlake.operators import code as C
from spanlake.operators import contains
from spanlake.operators import search as S


def within(spark, seconds, run):
    """What `run` gives; its jobs are cancelled after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def written(spark, run):
    """What `run` gives, and the MB that it leaves below the checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names) / 1e6
    before = size()
    return run(), size() - before


def test_router_modules_that_end_alike(spark):
    """Each of 12,000 files includes the router beside it: all modules share two suffixes with all files."""
    n = F.col("id").cast("string")
    edges = spark.range(12_000).select(F.concat(F.lit("m"), n, F.lit("/main.py")).alias("caller"), F.lit(0).alias("no"), F.concat(F.lit("m"), n, F.lit(".api.routes")).alias("module"), F.concat(F.lit("/p"), n).alias("prefix"))
    units = spark.range(12_000).select(F.col("id").alias("unit_id"), F.concat(F.lit("m"), n, F.lit("/api/routes.py")).alias("source_file"), F.lit("GET /x").alias("route_path"))
    got = within(spark, 60, lambda: C.resolve_router_prefixes(units, edges).collect())
    assert {(r["unit_id"], r["route_path"]) for r in got} == {(i, f"GET /p{i}/x") for i in range(12_000)}


def test_many_units_of_one_route(spark):
    """40,000 requests fit the one route of 40,000 units."""
    n = F.col("id").cast("string")
    units = spark.range(40_000).select((F.col("id") + 7).alias("unit_id"), F.lit("GET /api/{id}/items/{id}").alias("route_path"))
    queries = spark.range(40_000).select(F.col("id").alias("query_id"), F.concat(F.lit("/api/"), n, F.lit("/items/7")).alias("text"))
    got = within(spark, 60, lambda: S.lookup_route_fuzzy(queries, units).select("query_id", "unit_id", "score").collect())
    assert len(got) == 40_000 and {tuple(r)[1:] for r in got} == {(7, 1.0)}
    got = within(spark, 60, lambda: S.lookup_route(queries, units, 2).select("query_id", "unit_id", "score", "rank").collect())
    assert len(got) == 80_000 and {tuple(r)[1:] for r in got} == {(7, 1.0, 1), (8, 1.0, 2)}


def test_routes_meet_as_by_route_matches(spark):
    routes = ["/a/{x}", "/{x}/b", "/a/b", "/{x}/{y}", "/a{x}/b", "/a/{}/c", "//a/b/", "/", "/{x}", "/a/{id}/c/{id}", "/=a/b"]
    paths = ["/a/b", "/a/1", "/7/b", "/a/1/c", "/", "/q", "/a/2/c/5", "/{}/b", "/=a/b", "/a{x}/b", "/a//c", "/z/9"]
    units = spark.createDataFrame([(i, f"GET {r}") for i, r in enumerate(routes)], "unit_id long, route_path string")
    queries = spark.createDataFrame(list(enumerate(paths)), "query_id long, text string")
    both = queries.crossJoin(units.withColumn("route", F.substring_index("route_path", " ", -1)))
    fits = lambda path: F.col("route").contains("{") & route_matches(F.col("route"), path)
    want = {tuple(r) for r in both.select("query_id", "unit_id", F.when(F.col("text") == F.col("route"), 2.0).when(fits(F.col("text")), 1.0).alias("s")).filter("s is not null").collect()}
    assert {tuple(r) for r in S.lookup_route(queries, units, 100).select("query_id", "unit_id", "score").collect()} == want
    found = F.lit(False)
    for path in (normalize_route(F.col("text")), normalize_hex_route(F.col("text"))):
        found = found | path.endswith(F.col("route")) & (F.col("route") != "") & F.col("route").startswith("/") & ~F.col("route").isin("/") | (path == F.col("route")) | fits(path)
    got = {tuple(r) for r in S.lookup_route_fuzzy(queries, units, 100).select("query_id", "unit_id").collect()}
    assert got == {tuple(r) for r in both.filter(found).select("query_id", "unit_id").collect()}


def test_holders_equal_contains(spark, monkeypatch):
    """Also with more lengths than are looked up as they are."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé\n ") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "abc", "abc"]
    needles = [t[i : i + rng.randint(0, 30)] for t in texts if t for i in [rng.randrange(len(t))]] + ["zzz", "", None, "a" * 500]
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(x, i) for x in needles for i, y in enumerate(texts) if x is not None and y is not None and x in y}
    for most in (64, 3):
        monkeypatch.setattr(contains, "LENGTHS", most)
        got = [tuple(r) for r in contains.holders(n, t).collect()]
        assert set(got) == want and len(got) == len(want)


def _texts(rng, n, length):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length)) for _ in range(n)]


def test_keywords_keep_hits_only(spark):
    """Neither texts nor their trigrams are stored; the units are all pairs' best, also with words that many units have."""
    rng = random.Random(3)
    bodies = _texts(rng, 1500, 2000)
    rows = [(i, f"f{i}", f"a.f{i}", "function", f"a/{i % 9}.py", b) for i, b in enumerate(bodies)]
    units = spark.createDataFrame(rows, "unit_id long, name string, qualified_name string, unit_type string, source_file string, body_text string")
    asked = [(i, [bodies[rng.randrange(1500)][at : at + n] for n in (3, 3, 4, 5) for at in [rng.randrange(1990)]] + rng.choice([[], ["f12"], ["/2.", "/2."]])) for i in range(60)]
    asked += [(100 + i, asked[7][1]) for i in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, keywords array<string>")
    got, mb = written(spark, lambda: sorted(tuple(r) for r in S.lookup_keywords(queries, units).collect()))
    want = []
    for q, words in asked:
        scores = Counter()
        for i, name, qualified, _, file, body in rows:
            for w in words:
                scores[i] += next((s for s, t in ((3, name), (2, qualified), (1.5, file), (1, body)) if w in t), 0)
        want += [(q, i, s, rank + 1) for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]) if s]
    assert got == sorted(want) and mb < 0.6, mb


def test_log_patterns_store_no_texts(spark):
    rng = random.Random(5)
    bodies = _texts(rng, 600, 3000)
    units = spark.createDataFrame([(i, [bodies[i % 200][:12], bodies[i % 7][5:11]]) for i in range(600)], "unit_id long, log_patterns array<string>")
    asked = [(i, b if i % 2 else b[2:8]) for i, b in enumerate(bodies)] + [(1000 + i, bodies[1]) for i in range(50)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got, mb = written(spark, lambda: sorted(tuple(r) for r in S.search_log_pattern(queries, units).collect()))
    want = []
    for q, text in asked:
        hits = [i for i in range(600) if any(text in p or p in text for p in (bodies[i % 200][:12], bodies[i % 7][5:11]))][:5]
        want += [(q, i, 0.5, rank + 1) for rank, i in enumerate(hits)]
    assert got == sorted(want) and mb < 2, mb


def test_a_keyword_that_all_share(spark):
    """20,000 queries and 6,000 units share a word; each query has another one of its own."""
    n = F.col("id").cast("string")
    code = spark.range(6000).select(F.col("id").alias("unit_id"), F.concat(F.lit("f"), n).alias("name"), F.lit("q").alias("qualified_name"), F.lit("function").alias("unit_type"), F.lit("p").alias("source_file"), F.concat(F.lit("get x"), F.format_string("%05d", "id")).alias("body_text"))
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.lit("GET"), F.concat(F.lit("x"), F.format_string("%05d", "id"))).alias("keywords"))
    got = within(spark, 60, lambda: S.lookup_keywords(queries, code, 1).collect())
    assert {(r["query_id"], r["unit_id"], r["score"]) for r in got} == {(i, i if i < 6000 else 0, 2.0 if i < 6000 else 1.0) for i in range(20_000)} and len(got) == 20_000


def test_index_with_recall_1_is_exact(spark):
    """More queries than are measured, vectors without structure, a clustered half, hot vectors and several vectors of an id."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 12))
    x[2000:] = x[rng.integers(0, 30, 2000)] + 0.05 * x[2000:]
    x[500:900] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0, 2.0]), (5002, [3.0, 1.0])]
    asks = [(i // 2 if i < 100 else i, x[i].tolist()) for i in range(0, 4000, 2)] + [(9000, [1.0, 1.0]), (9001, None)]
    units, queries = spark.createDataFrame(rows, "unit_id long, vector array<double>"), spark.createDataFrame(asks, "query_id long, vector array<double>")
    want = sorted(tuple(r) for r in S.vector_top_k(queries, units).collect())
    index = S.build_vector_index(units, side=300)
    for side in (20_000, 700):
        assert sorted(tuple(r) for r in S.vector_top_k_indexed(queries, index, recall=1.0, side=side).collect()) == want


def test_java_heads_below_long_comments():
    """A comment's lines are blanks to the heads; they aren't gone through again from each of them."""
    source = "class A {\n" + "// words of a long comment, one line of many\n" * 12_000 + "\n  record B(int a) { }\n}\n\f class C { }\n"
    start = time.process_time()
    got = [(u["name"], u["unit_type"], u["start_line"]) for u in X.EXTRACTORS[".java"](source, "a.java", "a")]
    assert got == [("A", "class", 1), ("B", "class", 12_003), ("C", "class", 12_005)] and time.process_time() - start < 20
