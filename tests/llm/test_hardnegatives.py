"""Hard negatives and the cover tree against all inner products."""

import duckdb
import numpy as np

from spanlake.llm.covertree import CoverTree, augmented, bounds, exact_products, search
from spanlake.llm.hardnegatives import RELABELLED, hard_negatives
from spanlake.llm.queries import ORACLE_SQL, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """The contract by all pairs; rows are (vec_id, embedding, label)."""
    v = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(e is None or not np.isfinite(e) for e in x):
            continue
        code = tuple(int(np.floor(np.float64(np.float32(e)) * 256)) for e in x)
        v[(i, (label + 1) % 10 if i % 7 == 0 else label, code)] = None
    out = []
    for a in (r for r in v if r[0] % 50 == 0):
        score = {r: sum(p * q for p, q in zip(a[2], r[2], strict=True)) for r in v if r != a and len(r[2]) == len(a[2])}
        near = sorted((r for r in score if r[1] == a[1]), key=lambda r: (-score[r], r[0]))[:positives]
        for p in near:
            fit = [r for r in score if r[1] != a[1] and low * score[p] <= 100 * score[r] <= high * score[p]]
            out += [(a[0], p[0], no, r[0], score[p], score[r]) for no, r in enumerate(sorted(fit, key=lambda r: (-score[r], r[0]))[:negatives], 1)]
    return sorted(out)


def vectors(rng, n=900, d=6):
    centres = rng.standard_normal((12, d)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * 0.4
    x[300:420] = x[300]  # a very common vector
    x[500:520] = np.round(x[500:520])
    rows = [(i, x[i].astype(np.float32).tolist(), int(rng.integers(0, 4)), i) for i in range(n)]
    return rows


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng)
    rows += [rows[50], rows[51], rows[300]]  # repeated rows
    rows += [(1000, None, 1, 0), (1050, [1.0] * 6, None, 0), (1100, [float("nan")] * 6, 1, 0), (1101, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 0), (None, [9.0] * 6, 1, 0), (1102, [float("inf")] * 6, 1, 0)]
    rows += [(1150 + i, [0.5 * (i % 5 + 1), 1.0], i % 3, 0) for i in range(101)]  # vectors of another length
    rows += [(1300, [0.0] * 6, 0, 0), (1350, [], 1, 0), (1351, [], 1, 0), (1353, [], 2, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert len(want) > 150
    for options in ({}, {"tasks": 4, "block": 50, "sample": 40}, {"group": 3, "sample": 2000}):
        got = sorted(tuple(r) for r in hard_negatives(df, "vec_id % 50 = 0", RELABELLED, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
        assert got == want, options


def test_windows_and_counts_are_parameters(spark):
    rows = vectors(np.random.default_rng(4), 400)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df, "vec_id % 50 = 0", RELABELLED, positives=2, negatives=7, least=10, most=100)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 2, 7, 10, 100)


def test_empty_and_few(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 50 = 0").count() == 0
    assert hard_negatives(spark.createDataFrame([(50, [1.0, 0.0], 1, 0)], SCHEMA), "vec_id % 50 = 0").count() == 0
    assert hard_negatives(spark.createDataFrame([(51, [1.0, 0.0], 1, 0), (52, [1.0, 0.0], 2, 0)], SCHEMA), "vec_id % 50 = 0").count() == 0


def test_tree_covers_and_bounds_hold():
    rng = np.random.default_rng(1)
    for n, d, scale in ((1, 3, 1), (700, 3, 300), (3000, 64, 40), (500, 2, 0)):
        x = (rng.standard_normal((n, d)) * scale).astype(np.int64)
        most = float(np.sqrt((x**2).sum(axis=1).max())) + 1
        tree, y = CoverTree(x, most, leaf=20, most_children=32), augmented(x, most)
        assert sorted(tree.order.tolist()) == list(range(n))
        held = np.zeros(n, int)
        for v in range(len(tree.centre)):
            rows = tree.order[tree.begin[v] : tree.end[v]]
            assert tree.centre[v] in rows and np.linalg.norm(y[rows] - y[tree.centre[v]], axis=1).max() <= tree.radius[v] + 1e-6
            held[rows] += tree.leaf[v]
        assert (held == 1).all()
        q = (rng.standard_normal((9, d)) * 3 * (scale + 1)).astype(np.int64)
        low, high = bounds((q @ x[tree.centre].T).astype(float), (q**2).sum(axis=1).astype(float), most, tree.radius)
        for v in range(len(tree.centre)):
            s = q @ x[tree.order[tree.begin[v] : tree.end[v]]].T
            assert (s.min(axis=1) >= low[:, v]).all() and (s.max(axis=1) <= high[:, v]).all()


def test_search_skips_nodes():
    """Clustered rows: most leaves stay closed, and the answers are those of all pairs."""
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 16))[rng.integers(0, 40, 8000)] * 500 + rng.standard_normal((8000, 16)) * 10).astype(np.int64)
    labels, ids, q = rng.integers(0, 3, 8000), rng.permutation(8000), x[:30]
    tree = CoverTree(x, float(np.sqrt((x**2).sum(axis=1).max())) + 1)
    s = exact_products(q, x)
    low, high = np.full((30, 2), -(1 << 62)), np.stack((np.full(30, 1 << 62), s.max(axis=1) // 2), axis=1)
    import spanlake.llm.covertree as module

    seen, real = [0], module.exact_products
    module.exact_products = lambda a, b: (seen.__setitem__(0, seen[0] + len(a) * len(b)), real(a, b))[1]
    try:
        ask, window, score, row = search(tree, x, labels, ids, q, labels[:30], low, high, low.copy(), False, 4)
    finally:
        module.exact_products = real
    assert seen[0] < 0.35 * s.size
    for i in range(30):
        for j in range(2):
            fit = np.flatnonzero((labels != labels[i]) & (s[i] <= high[i, j]))
            want = fit[np.lexsort((ids[fit], -s[i, fit]))][:4]
            assert row[(ask == i) & (window == j)].tolist() == want.tolist()


def test_query_equals_sql(spark, data):
    got = op12_hard_negatives(spark, data)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = db.sql(ORACLE_SQL["op12_hard_negatives"])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
