"""Toxicity and language ID."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanlake.llm.langid import identify, language_id, profiles
from spanlake.llm.toxicity import SLOTS, features, score, toxicity, train

DOCS = "doc_id long, text string, lang string, held_out string"


def toxic_tables(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Vile", "vile,", "awful!"])
        docs.append((i, " ".join(w), "en", "x"))
        if i % 4:
            labels.append((i, int(bad)))
    docs += [(9001, None, None, "x"), (9002, "", "en", "x"), (9003, "vile " * 5 + "word1 " * 30_000, "en", "x"), (9002, "", "en", "x")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (3, None), (3, 0)], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity(docs, labels).cache()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == docs.count()
    rows = [r for r in got.collect() if r["held_out"] and r["doc_id"] < 600]
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows) / len(rows)
    assert right > 0.95
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[9001]["score"] == by[9002]["score"] and by[9002]["predicted"] == 0
    assert by[9003]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in by.values())


def test_weights_are_sparse_and_only_from_learnt_rows(spark):
    docs, labels = toxic_tables(spark)
    w = train(docs, labels)
    assert 0 < w.count() < 2000
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(w.collect()) == sorted(train(docs, flipped).collect())


def test_no_labels_and_no_documents(spark):
    docs, labels = toxic_tables(spark)
    assert {r["score"] for r in score(docs, train(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).count() == 0


def language_docs(spark):
    rng = random.Random(5)
    kinds = {"aa": ["banana", "papaya", "mañana"], "bb": ["kirsch", "früh", "zwetschge"], "cc": ["щука", "река", "борщ"]}
    docs = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(4, 80))), k, "x") for i in range(200) for k in [sorted(kinds)[i % 3]]]
    docs += [(901, None, "aa", "x"), (902, "123 ... 45", "aa", "x"), (903, "", None, "x"), (904, "banana " * 40_000, None, "x"), (905, "ЩУКА!", None, "x")]
    return spark.createDataFrame(docs, DOCS)


def test_languages(spark):
    docs = language_docs(spark)
    got = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert len(got) == docs.count()
    assert all(got[i]["lang_pred"] == ["aa", "bb", "cc"][i % 3] for i in range(200))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (901, 902, 903))
    assert got[904]["lang_pred"] == "aa" and got[905]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_profile_is_the_brute_force_ranking(spark):
    docs = spark.createDataFrame([(1, "ab ab b", "xx", ""), (2, "ab", "xx", ""), (6, "zz", "yy", "")], DOCS).filter("crc32(cast(doc_id as string)) % 5 <> 0")
    texts = [r["text"] for r in docs.filter("lang = 'xx'").collect()]
    counts: dict = {}
    for w in " ".join(texts).split():
        p = f"_{w}_"
        for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
            counts[g] = counts.get(g, 0) + 1
    code = lambda c: 0 if c == "_" else ord(c)

    def key(g):
        k = 0
        for c in g:
            k = k << 21 | code(c)
        return k - (1 << 63) if len(g) == 2 else k

    want = sorted(counts, key=lambda g: (-counts[g], key(g)))[:5]
    got = [r["gram"] for r in profiles(docs, 5).filter("lang = 'xx'").orderBy("rank").collect()]
    assert got == [key(g) for g in want]


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "abc", None, "")], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in language_id(docs).collect()] == [("und", 0.0)]
    assert language_id(docs.limit(0)).count() == 0


def test_training_equals_plain_ftrl(spark):
    """z, n and weights of the published update, one coordinate at a time."""
    docs, labels = toxic_tables(spark)
    alpha, beta, l1, l2, epochs = 2.0, 1.0, 3.0, 0.01, 2
    got = {r["slot"]: r["weight"] for r in train(docs, labels, epochs=epochs, l1=l1).collect()}
    known: dict = {}
    for r in labels.collect():
        if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            known[r["doc_id"]] = max(r["toxic"], known.get(r["doc_id"], 0))
    rows = [(r["doc_id"], features([(r["text"] or "").encode()])[0].tolist()) for r in docs.collect() if r["doc_id"] in known]
    rows.sort(key=lambda r: (r[0], len(r[1])))
    z, n = {}, {}

    def weight(i):
        bar = 0.0 if i == 1 << SLOTS else l1
        if abs(z.get(i, 0.0)) <= bar:
            return 0.0
        return ((1 if z[i] > 0 else -1) * bar - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for e in range(epochs):
        for k in np.random.default_rng(e).permutation(len(rows)):
            slots = [*rows[k][1], 1 << SLOTS]
            w = [weight(i) for i in slots]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - known[rows[k][0]]
            for i, x in zip(slots, w, strict=True):
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * x
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)


def test_languages_by_plain_out_of_place_distance(spark):
    docs = language_docs(spark)
    size = 30
    learned = profiles(docs, size)
    ranks: dict = {}
    for r in learned.collect():
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    for r in identify(docs.filter("doc_id < 60 or doc_id > 900"), learned, size).collect():
        counts: dict = {}
        for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()):
            p = f"\0{w}\0"
            for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
                k = 0
                for c in g:
                    k = k << 21 | ord(c)
                k -= (1 << 63) * (len(g) == 2)
                counts[k] = counts.get(k, 0) + 1
        top = sorted(counts, key=lambda g: (-counts[g], g))[:size]
        if not top:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(own[g] - i) if g in own else size for i, g in enumerate(top)) for lang, own in ranks.items()}
        lang = min(far, key=lambda x: (far[x], x))
        assert (r["lang_pred"], r["score"]) == (lang, 1 - far[lang] / (size * len(top)))


def test_own_columns_are_replaced(spark):
    docs = language_docs(spark).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(7))
    got = identify(docs, profiles(docs))
    assert got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"] and got.filter("lang_pred = 'mine'").count() == 0
