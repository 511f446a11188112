"""Mixing, decontamination, neighbours and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from spanlake.llm.common import without
from spanlake.llm.decontaminate import align, contaminated
from spanlake.llm.mixing import leaf_budgets, mix
from spanlake.llm.neighbours import gridded, hilbert_keys, nearest, reach

DOCS = "doc_id long, text string, lang string, source string, epoch string"


def test_mix_takes_token_prefixes(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), rng.choice(["en", "fr", None]), rng.choice(["src0", "src1"]), "x") for i in range(300)]
    rows += [(900, None, "en", "src0", "x"), (901, "", "en", None, "x"), (902, "w w", None, None, "x"), (902, "w w", None, None, "x")]
    df = spark.createDataFrame(rows, DOCS)
    total = sum(len((r[1] or "").split()) for r in rows)
    for share in (0.3, 1.7):
        got = mix(df, share=share, max_epochs=3).collect()
        taken = sum(r["taken"] for r in got)
        assert taken == int(total * share)
        assert all(0 < r["taken"] <= r["tokens"] for r in got)
        for leaf in {(r["lang"], r["source"]) for r in got}:
            own = [r for r in got if (r["lang"], r["source"]) == leaf]
            last = max(r["epoch"] for r in own)
            part = sorted((r for r in own if r["epoch"] == last), key=lambda r: hashlib.md5(f"mix:{last}:{r['doc_id']}".encode()).hexdigest())
            assert all(r["taken"] == r["tokens"] for r in part[:-1] if r["doc_id"] != 902)
            assert sum(r["taken"] < r["tokens"] for r in own) <= 1
    assert mix(df, total_tokens=10**9).agg({"taken": "sum"}).first()[0] == 2 * total
    assert mix(df.limit(0)).count() == 0


def test_mix_returns_cut_texts(spark, data):
    import corpus_pipeline as P

    rows = [(i, f" a{i}  b\tmail\n[EMAIL] é{i} ", "en", "s", "x") for i in range(20)] + [(None, "no id here", "en", "s", "x"), (3, "same id, another text", "en", "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    for got in (mix(docs, total_tokens=52, with_text=True).collect(), P.STAGES[-1][1](spark, docs, data).collect()):
        whole = {r[1] for r in rows}
        assert all(len(r["text"].split()) == r["taken"] for r in got)
        assert all(r["text"] in whole if r["taken"] == r["tokens"] else any(t.startswith(r["text"]) for t in whole) for r in got)
    assert any(r["taken"] < r["tokens"] for r in mix(docs, total_tokens=52, with_text=True).collect())


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("long", "en", "a", 10), ("long", "en", "b", 1000), ("long", "fr", "a", 1000), ("short", "en", "a", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in leaf_budgets(leaves, {}, 800, 0.5, 1).collect()}
    assert got == {("long", "en", "a"): 10, ("long", "en", "b"): 190, ("long", "fr", "a"): 200, ("short", "en", "a"): 400}


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, matched, begin, end = align(a, b)
        assert score == h.max() and 0 <= begin <= end <= len(b) and 2 * matched >= score


def plain_score(a, b):
    best, h = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, new[j] - 1))
        h = new
        best = max(best, *h)
    return best


def test_alignment_in_windows_equals_one_table():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40):
        a = rng.integers(0, 30, n)
        b = rng.integers(0, 30, 5000)
        for _ in range(8):
            at = rng.integers(0, 4900)
            b[at : at + n] = np.where(rng.random(n) < 0.7, a, 99)
        score, _, begin, end = align(a, b)
        assert score == plain_score(a.tolist(), b.tolist()) == plain_score(a.tolist(), b[begin:end].tolist())


def test_contaminated_equals_all_pairs(spark):
    """Items of 3, 4, 5 and more words, repeated grams, repeated ids and long texts against every alignment."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    edited = lambda w, k: [x if (j + 1) % k else rng.choice(words) for j, x in enumerate(w)]
    items = [(k, some(n)) for k, n in enumerate((3, 3, 4, 5, 5, 8, 20, 40))] + [(30, "alpha beta gamma delta epsilon zeta".split())] + [(20, ["go"] * 4), (21, "ab cd ab cd ab cd".split()), (3, some(6))]
    docs = []
    for i in range(160):
        w = some(rng.choice((4, 30, 200)))
        for _ in range(rng.randint(0, 2)):
            copy = list(rng.choice(items)[1])
            for j in range(len(copy)):
                if rng.random() < 0.12:
                    copy[j] = rng.choice(words)
            at = rng.randint(0, len(w))
            w[at:at] = copy
        docs.append((i, w))
    docs.append((500, some(3000) + items[7][1] + some(3000) + items[0][1] + some(10) + items[7][1][:30]))
    docs.append((501, items[6][1] * 300))
    docs += [(600 + j, some(40) + edited(items[k][1], j) + some(40)) for j in range(2, 9) for k in (5, 6, 7)]
    docs += [(700, "beta alpha x gamma delta epsilon zeta".split()), (701, [x for y in items[6][1] for x in (y, "between")])]
    allowed = {}
    for i, w in docs:
        for k, item in items:
            share = plain_score(item, w) / (2 * len(item))
            if share >= 0.5:
                allowed[i, k] = max(share, allowed.get((i, k), 0))
    got = contaminated(spark.createDataFrame([(i, " ".join(w), 1) for i, w in docs], "doc_id long, text string, copy int"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()}
    assert got == allowed and len(allowed) > 140 and (701, 6) in got


def test_long_items_count_by_their_parts(spark):
    item = [f"q{i}" for i in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(item[4200:4900])), (2, " ".join(item[:1500])), (3, "x " * 50 + " ".join(item))], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in got) == [(1, 7, 700 / 904), (3, 7, 1.0)]


def test_contaminated_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(12)] + [(90, "too short"), (91, None)]
    docs, want = [], set()
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        if i % 4 == 0:
            k = i // 4 % 12
            copy = items[k][1].split()
            if i % 8 == 0:
                copy = [x if (j + 1) % 6 else "edited" for j, x in enumerate(copy)]
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(w), "x"))
    docs += [(i, items[0][1].upper(), "x") for i in range(1000, 1300)] + [(2000, None, "x"), (2001, "", "x"), (1000, items[0][1].upper(), "x")]
    want |= {(i, 0) for i in range(1000, 1300)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    texts = dict((d[0], d[1]) for d in docs)
    r = next(r for r in got if r["doc_id"] == 4)
    assert texts[4].split()[r["begin"] : r["end"]] == items[1][1].split() and r["score"] == 1
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_edited_passages_in_many_documents(spark):
    """Every 4th or 5th word replaced, in more documents than any rarity limit allows, next to rarer whole copies."""
    rng = random.Random(5)
    items = [(0, " ".join(f"a{j}" for j in range(38))), (1, " ".join(f"b{j}" for j in range(38))), (2, "tiny little item"), (3, "echo echo echo echo")]
    four, five = (" ".join("edited" if (j + 1) % k == 0 else w for j, w in enumerate(items[i][1].split())) for i, k in ((0, 4), (1, 5)))
    around = lambda text: " ".join([*(f"x{rng.randrange(500)}" for _ in range(60)), text, *(f"x{rng.randrange(500)}" for _ in range(60))])
    docs = [(i, around(four)) for i in range(150)] + [(i, around(five)) for i in range(200, 350)] + [(400, around(items[0][1]))]
    docs += [(500, around(items[2][1])), (501, items[2][1]), (502, around(items[3][1])), (503, around("tiny little")), (504, around("a0 a1 a2"))]
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, 0) for i in range(150)} | {(i, 1) for i in range(200, 350)} | {(400, 0), (500, 2), (501, 2), (502, 3)}
    want |= {(503, 2)}  # two of three words: two thirds of the item's score
    assert got.keys() == want
    texts = dict(docs)
    for i in (7, 207):
        r = got[(i, i // 200)]
        words = texts[i].split()[r["begin"] : r["end"]]
        assert len(words) >= 35 and r["matched"] == sum(w[0] == "ab"[i // 200] for w in words)


def test_hilbert_curve_is_a_continuous_bijection():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20):
    ok = [(i, np.array(v)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            s = sorted(((-(q @ v), j) for j, v in ok if j != i))
            out[i] = [(j, -d) for d, j in s[:k]]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1100)] + [(i, rows[7][1]) for i in range(400, 405)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [1.0] * 7), (2100, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in sorted(nearest(df, "vec_id % 20 = 0").collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_recall_through_small_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in nearest(df, "vec_id % 20 = 0", window=150, block=700).collect()}
    want = {(q, j) for q, near in brute(rows).items() for j, _ in near}
    assert len(got & want) / len(want) > 0.9


def test_window_is_measured(spark):
    """Without a given window recall holds, for clusters and without any structure, and scores are exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    for x in (rng.normal(size=(4000, 16)), centres[rng.integers(0, 30, 4000)] + 0.05 * rng.normal(size=(4000, 16))):
        rows = [(i, e.astype(np.float32).tolist()) for i, e in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = nearest(df, "vec_id % 20 = 0", block=900, sample=2500).collect()
        y = np.array([r[1] for r in rows])
        s = y[::20] @ y.T
        s[np.arange(200), np.arange(200) * 20] = -np.inf
        want = {(20 * i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:20]}
        assert len(got) == 4000 and len({(r["query_id"], r["vec_id"]) for r in got} & want) / 4000 > 0.9
        for r in got[::97]:
            total = 0.0
            for a, b in zip(rows[r["query_id"]][1], rows[r["vec_id"]][1], strict=True):
                total += a * b
            assert r["score"] == total


def test_window_follows_the_measured_distances():
    assert reach(np.full((48, 100), 500.0), 10**6, 0.94) == 552
    assert reach(np.full((48, 100), 4e5), 10**6, 0.94) is None and reach(np.full((48, 100), 2e4), 10**6, 0.94) is None
    apart = np.where(np.arange(48)[:, None] % 8 == np.arange(100)[None, :] % 8, 10.0, 1e5)
    assert reach(apart, 10**6, 0.94) == 200


def test_exact_search_in_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    points = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "point long, x array<double>")
    got = {r["asked"]: [-e["back"] for e in r["near"]] for r in gridded(points, points.filter("point % 7 = 0"), 300, 43, 5, 40).collect()}
    assert got == {i: np.argsort(-(x[i] @ x.T))[:5].tolist() for i in range(0, 300, 7)}


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(two, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 2.0)]
    assert nearest(two.filter("vec_id = 0"), "vec_id % 20 = 0").count() == 0


def test_without_keeps_all_other_rows(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, i) for i in range(3000)], "key long, n int")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "key long")
    for most_bits in (6, 26):
        got = {r["n"] for r in without(rows, "key", ids, most_bits).collect()}
        assert got == {i for i in range(3000) if i % 10 == 0 or i % 7}
    assert without(rows, "key", ids.limit(0)).count() == 3000


def test_duplicate_stage_equals_brute_force(spark, data):
    """Null ids, ids with several texts, repeated rows: one row for each group of linked texts, the smallest id first."""
    import corpus_pipeline as P

    rng = random.Random(12)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 60))] for _ in range(20)]
    rows = []
    for i in range(120):
        w = [x if rng.random() > 0.01 else "new" for x in rng.choice(base)]
        rows.append((rng.choice([None, i, i, i // 3]), " ".join(w), "en", rng.choice(["a", None]), 1))
    rows += rows[:15] + [(None, None, "en", "a", 0), (500, "", "en", "a", 0), (500, "x y", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_duplicates(spark, docs, data).collect()
    names = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    group = {x: x for x in names}

    def find(x):
        return x if group[x] == x else find(group[x])

    sets = {x: {tuple(x[2].split()[k : k + 5]) for k in range(max(1, len(x[2].split()) - 4))} if x[2].split() else set() for x in names}
    for x in names:
        for y in names:
            c = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and 100 * c >= 75 * (len(sets[x]) + len(sets[y]) - c):
                a, b = sorted((find(x), find(y)))
                group[b] = a
    groups: dict = {}
    for x in names:
        groups.setdefault(find(x), set()).add(x)
    kept = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got]
    assert len(kept) == len(set(kept)) == len(groups)
    for members in groups.values():
        (mine,) = members & set(kept)
        # of several texts of the smallest id, the one of the smallest hash has the id as its key
        assert mine[:2] == min(members)[:2] or sum(1 for r in rows if r[0] == min(members)[1] and r[1] is not None) > 1


def test_pipeline_stages(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        new = spark.createDataFrame(stage(spark, kept, data).toPandas(), docs.schema)
        assert new.columns == list(P.COLUMNS)
        assert {r[0] for r in new.select("doc_id").collect()} <= {r[0] for r in kept.select("doc_id").collect()}, name
        kept = new
    assert kept.count() > 0.5 * docs.count()
    last = P.STAGES[-1][1](spark, kept, data)
    assert last.count() > 0 and last.join(kept, "doc_id", "left_anti").count() == 0


def test_pipeline_on_odd_rows(spark, data):
    import corpus_pipeline as P

    rows = [(1, "the words of one text are here", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 4), (5, "the words of one text are here", None, None, 1), (None, "no id at all here", "en", "s", 1), (7, "mail a@b.cc", "en", "s", 11), (7, "mail a@b.cc", "en", "s", 11)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).astype(object).where(lambda x: x.notna(), None).values.tolist(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == [(1, "the words of one text are here"), (7, "mail [EMAIL]"), (None, "no id at all here")]
    assert P.STAGES[-1][1](spark, docs, data).count() > 0


def test_one_id_with_different_vectors(spark):
    """Each is a query and a candidate of its own; results equal all inner products."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(300)] + [(0, (-x[0]).tolist()), (0, x[7].tolist()), (2**61 + 20 - 2**61 % 20, x[9].tolist()), (41, x[0].tolist()), (40, x[40].tolist())]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").collect()
    kept = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    want, y = {}, [np.array(v, np.float64) for _, v in kept]
    for n, (i, v) in enumerate(kept):
        if i % 20 == 0:
            score = [(-sum(a * b for a, b in zip(y[n], y[m], strict=True)), kept[m][0]) for m in range(len(kept)) if m != n]
            want.setdefault(i, []).append([(j, -s) for s, j in sorted(score)[:20]])
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], {}).setdefault(r["query_version"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and len(found[0]) == 3 and len(found[40]) == 1
    for i, versions in found.items():
        for mine, own in zip(sorted(versions.values()), sorted(want[i]), strict=True):
            assert [j for j, _ in mine] == [j for j, _ in own]
            assert [s for _, s in mine] == pytest.approx([s for _, s in own], rel=1e-12)


def test_evenly_edited_copies(spark):
    """Copies that keep no run of three words, or of two, but half of the item's score; small words repeat everywhere."""
    item = [f"k{j}" for j in range(38)]
    prose = "the of and to in a is that it was for on".split()
    rng = random.Random(2)
    around = [rng.choice(prose) for _ in range(300)]
    third = [w if (j + 1) % 3 else "edited" for j, w in enumerate(item)]
    spaced = [x for w in item for x in (w, "um")]
    small = "alpha beta gamma delta epsilon zeta".split()
    eight = [f"e{j}" for j in range(8)]
    docs = [(1, third), (2, spaced), (3, small[:2] + ["x"] + small[3:]), (4, eight[:2] + ["x"] + eight[3:5] + ["y"] + eight[6:]), (5, []), (6, item[:17])]
    common = [(9, rng.choices(prose, k=15)), (10, item), (11, small), (12, eight)]
    docs = [(i, " ".join(around[:150] + w + around[150:])) for i, w in docs]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in common], "item_id long, text string")).collect()}
    want = {(i, k): plain_score(w, t.split()) / (2 * len(w)) for i, t in docs for k, w in common if plain_score(w, t.split()) >= len(w)}
    assert got == want and want.keys() >= {(1, 10), (2, 10), (3, 11), (4, 12)} and (6, 10) not in got


def test_decontamination_stage_equals_all_pairs(spark, tmp_path):
    """The pipeline's stage keeps exactly the rows of which no item's alignment passes; null ids and shared ids are rows of their own."""
    import corpus_pipeline as P

    rng = random.Random(12)
    words = [f"v{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, some(n)) for k, n in enumerate((4, 12, 25, 30))]
    rows = []
    for i in range(120):
        w = some(rng.choice((5, 60)))
        if i % 2:
            copy = [x if rng.random() > 0.3 else rng.choice(words) for x in rng.choice(items)[1]]
            w[3:3] = copy
        rows.append((i if i % 10 else None, " ".join(w), "en", "s", len(w)))
    rows += [(7, " ".join(items[2][1]), "en", "s", 1), (8, None, None, "s", None), (9, "", "en", None, 0), rows[1]]
    spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dict(P.STAGES)["decontamination"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    clean = [r for r in rows if not any(plain_score(w, (r[1] or "").split()) >= len(w) for _, w in items)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clean)) and 50 < len(clean) < 110
