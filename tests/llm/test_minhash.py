import random
import re

import numpy as np
import pytest

from spanlake.llm.common import hot_keys, spread_join
from spanlake.llm.components import connected_components
from spanlake.llm.minhash import TIER, Circulant, near_duplicates, shingle_sets, signatures, tiers

SCHEMA = "doc_id long, text string"


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                p, q = sorted((find(a), find(b)))
                group[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 6)):
            w = [x if rng.random() > 0.03 else rng.choice(words) for x in base]
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(w)))
            n += 1
    rows += [(n, rows[0][1].upper()), (n + 1, "one two"), (n + 2, "One  two"), (n + 3, "two one"), (n + 4, ""), (n + 5, None), (n + 6, " \n")]
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_chain_of_neighbours(spark):
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_group_of_copies_and_one_long_text(spark):
    long_ = " ".join(f"x{i}" for i in range(20_000))
    rows = [(i, "the same words in all of these copies") for i in range(10, 300)] + [(1, long_), (2, long_ + " end"), (3, "z" * 200_000)]
    got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {got[i][1] for i in range(10, 300)} == {10}
    assert got[2][1] == 1 and got[3] == (1, 3, True)


def test_edges_of_the_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    extra = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", component_id long, key string")
    got = sorted(near_duplicates(extra).collect(), key=str)
    assert len(got) == 4
    assert [r["component_id"] for r in got if r["doc_id"] == 1] == [1, 1]


def test_signature_estimates_similarity():
    c = Circulant(64, 6, 7)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)))
    assert abs((c.signature(a) == c.signature(b)).mean() - 800 / 1200) < 0.1


def test_short_text_is_one_shingle():
    sets = list(shingle_sets([b"a b c", b"", b"a b c d e", b"A B\tC"], 5))
    assert [len(s) for s in sets] == [1, 0, 1, 1]
    assert sets[0] == sets[3] and sets[0] != sets[2]


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r["id"], r["component"]) for r in connected_components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_unlike_long_texts_share_no_bucket(spark):
    """50 texts of 100,000 words, and one of 400,000: no keys in common, but for a copy that is nearly whole."""
    c = Circulant(64, 6, 7)
    rng = np.random.default_rng(3)
    keys: dict = {}
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in [100_000] * 50]
    near = sets[0].copy()
    near[:8000] = rng.integers(0, 1 << 63, 8000)
    for i, s in enumerate([*sets, near]):
        for k in c.keys(c.signature(s, 1)[None, :], 1)[0]:
            keys.setdefault(int(k), set()).add(i)
    assert {tuple(sorted(v)) for v in keys.values() if len(v) > 1} == {(0, 50)}
    last = [c.signature(rng.integers(0, 1 << 63, 3000).astype(np.uint64), 2) for _ in range(2)]
    assert (last[0] == last[1]).mean() == 0


def test_similar_sets_share_a_tier():
    for n in [1, 3000, TIER, TIER + 1, TIER * 64, TIER * 64 + 1, 10**7]:
        for m in {n, -(-3 * n // 4), n + n // 3}:
            assert set(tiers(n, 75)) & set(tiers(m, 75))


def test_tiers_meet_and_long_copies_link(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    long_ = [rng.choice(words) for _ in range(4300)]
    rows = [(1, " ".join(long_)), (2, " ".join(long_[:3800])), (3, " ".join(long_[:3300])), (4, " ".join(rng.choice(words) for _ in range(4300)))]
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert {r["doc_id"]: r["count"] for r in signatures(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id").count().collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_an_id_with_several_texts_has_one_set(spark):
    rows = [(7, "a b c d e f g h"), (7, "q r s t u v w x"), (3, "a b c d e f g h"), (5, "q r s t u v w x"), (9, "a b c d e f g h")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    seven = {r["component_id"] for r in got if r["doc_id"] == 7}
    assert len(seven) == 1 and seven <= {3, 5}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 9)} == {3} and {r["component_id"] for r in got if r["doc_id"] == 5} == {5}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_plain_join(spark, how):
    """One key with half of the rows, null keys, and a key that the other side holds twice or not at all."""
    many = [(1 if i % 2 else None if i % 10 == 0 else i, i) for i in range(5000)]
    few = [(1, "a"), (1, "b"), (2, "c"), (None, "d")]
    left, right = spark.createDataFrame(many, "k long, n long").checkpoint(), spark.createDataFrame(few, "k long, s string")
    got = sorted(map(str, spread_join(left, right, ["k"], how).select("k", "n", "s").collect()))
    assert got == sorted(map(str, left.join(right, "k", how).select("k", "n", "s").collect()))
    assert [(r["k"], r["__parts"]) for r in hot_keys(left, ["k"]).collect()] == [(1, 501)]
