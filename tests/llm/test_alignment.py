"""Cross-tokenizer alignment against plain encoding of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from spanlake.llm import alignment
from spanlake.llm.alignment import aligned, coalesce, cross_tokenizer, overlaps
from spanlake.llm.queries import op13_cross_tokenizer

PARTS = [" ", "  ", "\n", "\t", " \n ", "a", "the", "ing", "é", "日本", "👍🏽", "\xa0", "　", "▁", ".", "1234", "\x00", "<s>", "<|endoftext|>", "\r\n", "'s", "Ünï", "\x85", "​", "    ", "<0x41>", "́"]


def plain(texts):
    """What the contract says, text by text, with the tokenizers' own libraries."""
    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    letters = alignment._byte_letters()
    spell_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))]
    rows, count = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(spell_a[i] for i in x) != whole or b"".join(spell_b[i] for i in y) != whole:
            x, y = [], []
        ends = [np.cumsum([len(s[i]) for i in ids]).tolist() for s, ids in ((spell_a, x), (spell_b, y))]
        groups, links, last = [], [], (0, 0)
        for stop in sorted(set(ends[0]) & set(ends[1])):
            now = ends[0].index(stop) + 1, ends[1].index(stop) + 1
            groups.append(",".join(map(str, x[last[0] : now[0]])) + "|" + ",".join(map(str, y[last[1] : now[1]])))
            last = now
        for i, e in enumerate(ends[0]):
            for j, f in enumerate(ends[1]):
                if max(e - len(spell_a[x[i]]), f - len(spell_b[y[j]])) < min(e, f):
                    links.append((x[i], y[j]))
        count.update(links)
        rows.append((len(x), len(y), groups, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in rows
    ]


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 16))) for _ in range(150)]
    prose = [" ".join(rng.choice(["token", "tokens", "alignment", "of", "the", "Überzug", "x1", "wh\n", "don't"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    return [None, "", " ", "\n", "a", "a ", *some, *prose, prose[0], prose[0], "z" * 3000, " " * 2000 + "x", "no▁space"]


def test_equals_plain_encoding(spark, monkeypatch):
    own = texts()
    rows = [(i if i != 7 else None, t, f"a{i}", i) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int").repartition(3)
    want = {(i if i != 7 else None): r for i, r in enumerate(plain(own))}
    for most in (2_000_000, 0):
        got = cross_tokenizer(docs, most_pairs=most).collect()
        assert len(got) == len(own)
        for r in got:
            assert tuple(r)[1:] == want[r["doc_id"]], own[r["doc_id"] or 7]


def test_pieces_and_groups(spark):
    own = [" ".join(f"word{i % 37}é" for i in range(400)), "one two", "three\n\nfour", None]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: r for r in aligned(docs, groups=True).collect()}
    know = alignment.aligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    for i, text in enumerate(own):
        r = whole[i]
        if text is None:
            assert (r["groups"], r["ends"], r["groups_sha256"]) == ("", [], "")
            continue
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]
        assert len(r["ends"]) == r["n_groups"] and r["ends"][-1] == len(text.encode()) and sum(r["counts"]) == r["n_links"]
        for group, stop, start in zip(r["groups"].split(";"), r["ends"], [-1, *r["ends"]], strict=False):
            ids = [[int(x) for x in side.split(",")] for side in group.split("|")]
            spelled = [b"".join(k.bytes[x] for x in side) for k, side in zip((know.a, know.b), ids, strict=True)]
            assert spelled[0] == spelled[1] == (b" " + text.encode())[start + 1 : stop + 1]


def test_long_texts_go_in_pieces(spark):
    """A text of more than PIECE_BYTES equals the plain encoding."""
    text = " ".join(f"w{i % 5000}x" for i in range(700_000))
    docs = spark.createDataFrame([(1, text), (2, "w1x w2x")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in aligned(docs).collect()}
    a = Tokenizer.from_file(alignment.VOCABULARY_A).encode(" " + text, add_special_tokens=False).ids
    assert len(text) > alignment.PIECE_BYTES and got[1]["n_a"] == len(a)
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B).encode(text)
    assert got[1]["n_b"] == len(b) and sum(got[1]["counts"]) == got[1]["n_links"] >= max(len(a), len(b))
    assert len(set(got[1]["pairs"])) == len(got[1]["pairs"])


def test_coalescing():
    a, b = np.array([3, 4, 9, 12]), np.array([1, 4, 8, 12])
    ga, gb = coalesce(np.array([0, 3, 4, 9]), a, np.array([0, 1, 4, 8]), b)
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 0, 1, 1]
    i, j = overlaps(np.array([0, 3, 4, 9]), a, np.array([0, 1, 4, 8]), b)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]


def test_empty_table_and_query(spark, data):
    assert cross_tokenizer(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_cross_tokenizer(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"]) < 400]
    want = plain([r["text"] for r in short])
    assert len(got) == len(docs) and all(got[r["doc_id"]][:4] + got[r["doc_id"]][6:] == w[:4] + w[6:] for r, w in zip(short, want, strict=True))
    assert all(r[4] <= r[3] <= r[5] for r in got.values())
