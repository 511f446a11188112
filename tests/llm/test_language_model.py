"""The recurrent language model: counts, gradients, whole-text likelihoods."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanlake.llm.common import Words
from spanlake.llm.language_model import _ending, fit, lm_scores, vocabulary, word_counts
from spanlake.llm.queries import op11_lm_scores
from spanlake.llm.recurrent import Adam, Recurrent, score, train

SCHEMA = "doc_id long, text string, word long, n int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def out_of_sample(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def plain(rows):
    counts, total = Counter(), 0
    for i, text, *_ in rows:
        if not out_of_sample(i):
            counts.update([*words(text), None])
    total = sum(counts.values())
    for i, text, *_ in rows:
        own = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        yield i, out_of_sample(i), len(own), sum(counts[w] > 0 for w in own), total, base


def corpus(n=300):
    rng = random.Random(4)
    lexicon = [["der", "Hund", "läuft", "schnell", "nach", "hause"], ["the", "dog", "RUNS", "quickly", "home", "É"]]
    rows = []
    for i in range(n):
        own = lexicon[i % 2]
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.9 else f"x{rng.randint(0, 400)}\t" for _ in range(rng.randint(0, 60))), 1, 1))
    rows += [(None, "the dog", 1, 1), (1000, None, 1, 1), (1001, "", 1, 1), (1002, " \n\x0b", 1, 1), (1003, "the " * 9000, 1, 1), (5, rows[5][1], 2, 2), (1004, "neverseen\xa0word", 1, 1), (1005, "a\x00b \x1f ", 1, 1)]
    return rows


def test_counts_and_base_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(plain(rows), key=str)
    found = []
    for most in (1000, 0):
        got = sorted((tuple(r) for r in lm_scores(docs, most_words=most, rounds=1).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
        assert all(g[6] < 0 for g in got)
        found.append(got)
    assert [g[6] for g in found[0]] == pytest.approx([g[6] for g in found[1]], rel=1e-3)


def test_learnt_scores_beat_counts(spark):
    rows = [r for r in corpus(600) if r[0] is not None and r[0] < 600]
    got = lm_scores(spark.createDataFrame(rows, SCHEMA)).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.9 * got["sum(base_score)"]  # which language a text is in takes about a bit a word


def test_nothing_to_learn_from(spark):
    assert lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b", 1, 1), (None, None, 1, 1)]
    got = sorted(tuple(r) for r in lm_scores(spark.createDataFrame(rows, SCHEMA)).select("n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    assert [g[:4] for g in got] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)] and all(g[4] <= 0 for g in got)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    counts = word_counts(docs).cache()
    vocab = vocabulary(counts, docs.count(), head=5, head_classes=2, endings=4)
    net = fit(docs, vocab, enough=10_000)
    state = net.states(np.array([[0], [3], [7]]), np.zeros((1, net.hidden), np.float32))[-1]
    table = {r["word"]: r["n"] for r in counts.collect()}
    total, seen = 0.0, Counter()
    for word, n, ending in ((r["word"], r["n"], r["ending"]) for r in counts.collect()):
        _, k, w = vocab.coded(np.array([word]), np.array([ending]))
        p = math.exp(net.log_probability(state, k, w)[0])
        if w[0] < 0:
            p *= (n + 0.1) / 10 ** vocab.log_total[k[0] - vocab.heads]
            seen[int(k[0])] += 1
        total += p
    for k in range(vocab.heads, len(vocab.class_mass)):  # one outcome for unseen words in each class by ending, and the end
        p = math.exp(net.log_probability(state, np.array([k]), np.array([-1]))[0])
        total += p if k == vocab.end[1] else p * 0.1 / 10 ** vocab.log_total[k - vocab.heads]
    assert total == pytest.approx(1, abs=1e-4) and len(table) > 100 and seen


def test_every_training_text_is_learnt_from(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), 1, 1) for i in range(100)]

    def weights(rows):
        docs = spark.createDataFrame(rows, SCHEMA)
        return fit(docs, vocabulary(word_counts(docs), len(rows)), enough=1, each=2000).parameters()  # four learners

    first = weights(rows)
    assert np.array_equal(first, weights(rows[::-1]))
    for i in (0, 41, 99):  # the same words in another order leave the counts as they are
        other = [(k, text[::-1] if k == i else text, *rest) for k, text, *rest in rows]
        assert not np.array_equal(first, weights(other)), i


def test_symbols_give_the_targets_of_whole_texts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    vocab = vocabulary(word_counts(docs), docs.count(), head=5, head_classes=2, endings=4)
    texts = [b"the dog RUNS", b"", b"xyz home home", b" "]
    (before, classes, own), bounds, w = vocab.tokens(texts)
    assert bounds.tolist() == [0, 4, 5, 9, 10]
    symbol, k, n = vocab.coded(w.hashes.view(np.int64), _ending(w))
    inside = np.delete(np.arange(10), bounds[1:] - 1)
    assert classes[inside].tolist() == k.tolist() and own[inside].tolist() == n.tolist()
    assert set(classes[bounds[1:] - 1]) == {vocab.end[1]} and set(own[bounds[1:] - 1]) == {-1}
    assert set(before[bounds[:-1]]) == {vocab.end[0]} and before[[1, 2, 3]].tolist() == symbol[:3].tolist()


def small(hidden=5):
    rng = np.random.default_rng(0)
    net = Recurrent(np.array([0, 0, 0, 1, 1]), rng.random(5) * 9, rng.random(5) * 9, 8, hidden)
    for p in ("classes", "words"):
        setattr(net, p, rng.standard_normal(getattr(net, p).shape).astype(np.float32))
    return net, rng


def draw(rng, n):
    symbols, classes = rng.integers(0, 8, n), rng.integers(0, 5, n)
    return symbols, classes, np.where(classes == 0, rng.integers(0, 3, n), np.where(classes == 1, rng.integers(3, 5, n), -1))


def test_gradients_are_those_of_differences():
    net, rng = small()
    t, b = 6, 3
    symbols, classes, own = (a.reshape(t, b) for a in draw(rng, t * b))
    fresh, real = rng.random((t, b)) < 0.2, rng.random((t, b)) < 0.8
    h = rng.standard_normal((b, net.hidden)).astype(np.float32)
    grad, _, _ = net.gradients(symbols, fresh, classes, own, real, h)
    for p, g in grad.items():
        a = getattr(net, p)
        for at in {tuple(rng.integers(0, s) for s in a.shape) for _ in range(12)}:
            side = []
            for step in (1e-2, -1e-2):
                keep = a[at]
                a[at] = keep + step
                side.append(-net.log_probability(net.states(symbols, h, fresh)[real], classes[real], own[real]).sum())
                a[at] = keep
            assert g[at] == pytest.approx((side[0] - side[1]) / 2e-2, abs=0.02), p


def test_states_are_carried_over_windows():
    net, rng = small()
    sizes = [1, 40, 7, 0, 300, 2]
    bounds = np.cumsum([0, *sizes])
    tokens = draw(rng, bounds[-1])
    got = score(net, *tokens, bounds)
    assert got == pytest.approx(score(net, *tokens, bounds, lanes=2, window=5), rel=1e-5)
    for i, n in enumerate(sizes):
        h, want = np.zeros((1, net.hidden), np.float32), 0.0
        for s, k, w in zip(*(a[bounds[i] : bounds[i + 1]] for a in tokens), strict=True):
            h = net.states(np.array([[s]]), h)[-1]
            want += net.log_probability(h, np.array([k]), np.array([w]))[0]
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_training_learns_an_order():
    net = Recurrent(np.arange(4), np.ones(4), np.ones(5), 5, 8)
    symbols = np.tile([0, 1, 2, 3], 2000)
    following = np.roll(symbols, -1)
    adam = Adam(net, 0.02)
    first, n = train(net, adam, symbols, following, following, np.array([0, len(symbols)]))
    for _ in range(4):
        last, _ = train(net, adam, symbols, following, following, np.array([0, len(symbols)]), lanes=4)
    assert n == 8000 and last < 0.2 * n < first


def test_endings_and_words():
    from spanlake.llm.language_model import _ending

    w = Words([b"Abc a", b"", b"\xc3\xa9"])
    assert _ending(w).tolist() == [(98 << 8) | 99, 97, (0xC3 << 8) | 0xA9]


def test_query(spark, data):
    got = {r["doc_id"]: r for r in op11_lm_scores(spark, data).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: r for r in plain(docs)}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert tuple(got[i])[:5] == r[:5] and got[i]["base_score"] == pytest.approx(r[5], rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)
