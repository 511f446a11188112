"""WARC revisits, section tokens, URL filters and PII."""

import hashlib
import random
import re

import numpy as np
import pytest

from spanlake.llm.pii import KINDS, LEARNT, base_spans, bootstrap, digest, edges_of, find_pii, graph_rows, pattern_key, redacted, tokens
from spanlake.llm.tokens import VOCABULARY, attribute, encoding, section_tokens
from spanlake.llm.urlfilter import judge_urls
from spanlake.llm.warc import canonical_url, resolve_revisits

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, slice string"


def test_revisits_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, rng.choice(["http://a.b/x", "HTTP://A.B/x#top", "http://a.b/y?utm_source=q", None]), rng.randrange(60_000) // 100, kind, rng.choice(["e1", 'W/"e"', "e1", None]), rng.choice(["d1", "d2", None]), {"date": str(i), "content-type": kind}, "x"))
    key = {"http://a.b/x": "http://a.b/x", "HTTP://A.B/x#top": "http://a.b/x", "http://a.b/y?utm_source=q": "http://a.b/y", None: None}
    want = {}
    for r in rows:
        if r[3] == "revisit":
            before = [q for q in rows if q[3] == "response" and key[q[1]] == key[r[1]] is not None and (q[2], q[0]) < (r[2], r[0])]
            q = max(before, key=lambda q: (q[2], q[0]), default=None)
            out = "no_response" if q is None else None
            if q and r[4] and q[4]:
                out = "resolved" if r[4].removeprefix("W/") == q[4].removeprefix("W/") else "stale"
            elif q and r[5] and q[5]:
                out = "resolved" if r[5] == q[5] else "stale"
            elif q:
                out = "unproven"
            want[r[0]] = (q and q[0], out, {"date": str(r[0]), "content-type": "response"} if out == "resolved" else None)
    got = resolve_revisits(spark.createDataFrame(rows, RECORDS), slice_width=37)
    assert {r["record_id"]: (r["response_id"], r["outcome"], r["headers"]) for r in got.collect()} == want


def test_revisits_of_nothing(spark):
    assert resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0
    rows = [(1, "u", None, "revisit", None, None, None, ""), (1, "u", None, "revisit", None, None, None, ""), (2, "u", 5, "response", None, None, None, "")]
    assert [r["outcome"] for r in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()] == ["no_response"] * 2


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.b:80/C/", "http://a.b/C"), ("https://a.b:443/?utm_a=1&x=2&utm_b=3#f", "https://a.b/?x=2"), ("plain", "plain"), (None, None), ("http://a.b", "http://a.b")],
)
def test_canonical_url(spark, url, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(canonical_url(F.col("url")).alias("u")).first()["u"] == want


def test_section_tokens_add_up(spark):
    rng = random.Random(4)
    texts = ["", None, "one line", "a\n\nb\n", "\n", "ünï\ncödé 漢字\nx" * 3, "word " * 20_000, "".join(rng.choice("ab \n\té") for _ in range(3000)), "<|endoftext|>\nx"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, tokens long")
    rows = section_tokens(df).collect()
    enc, _ = encoding(VOCABULARY)
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        ids = enc.encode_ordinary(t or "")
        assert sum(r["tokens"] for r in mine) == len(ids)
        assert mine[0]["start"] == 0 and mine[-1]["end"] == len(t or "")
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]
        assert [(r["end"] - r["start"]) for r in mine] == [len(x) for x in lines]
        ends = np.cumsum([len(enc.decode_single_token_bytes(k)) for k in ids], dtype=int)
        bounds = np.cumsum([0, *(len(x.encode()) for x in lines)])
        counts = [0] * len(lines)
        for b, e in zip([0, *ends[:-1]], ends, strict=False):
            held = [min(bounds[k + 1], e) - max(bounds[k], b) for k in range(len(lines))]
            counts[held.index(max(held))] += 1
        assert [r["tokens"] for r in mine] == counts


def test_section_tokens_of_unbroken_runs_and_repeated_rows(spark):
    run = "".join(random.Random(1).choices("abcdefgh", k=60_000))
    df = spark.createDataFrame([(1, run + "\n" + run), (1, run + "\n" + run), (None, "x")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["section"], r["end"] - r["start"], r["tokens"]) for r in section_tokens(df).collect())
    enc, _ = encoding(VOCABULARY)
    assert rows[0] == (0, 0, 1, 1) and rows[1] == rows[2] and rows[3] == rows[4] and [r[2] for r in rows[1:]] == [60_001, 60_001, 60_000, 60_000]
    assert rows[1][3] + rows[3][3] == len(enc.encode_ordinary(run + "\n" + run))


def test_crossing_tokens_go_to_the_larger_part():
    bounds = np.array([0, 3, 4, 10])
    assert attribute(np.array([0, 2, 3]), np.array([2, 4, 10]), bounds).tolist() == [0, 0, 2]


def test_section_tokens_of_nothing(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_url_rules(spark):
    urls = {
        1: ("https://WWW.Example.COM/en/a?b", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("http://x.example.com/en/1#f", "x.example.com", "/en/1", "example.com/en/", "block"),
        3: ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        4: ("http://com", "com", "", None, "allow"),
        5: ("ftp://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        6: ("http://a.net/ES/x", "a.net", "/ES/x", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/en/", "", "", None, "allow"),
        9: ("http://ÀB.net/fr/é://x", "Àb.net", "/fr/é://x", "net/fr/", "block"),
        10: ("", "", "", None, "allow"),
    }
    rows = [(i, u[0], "x") for i, u in urls.items()]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_impure_templates_are_rejected(spark):
    rules = (("block", "h.org", "/bad/1"), ("allow", "h.org", "/good/"))
    rows = [(i, f"http://h.org/bad/{i}") for i in range(100, 200)] + [(i, f"http://h.org/bad/{i}") for i in range(20, 30)] + [(i, f"http://h.org/good/{i}") for i in range(300, 340)]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i] for i in range(20, 30)} == {"block"} and {got[i] for i in range(300, 340)} == {"allow"}


def test_shapes_without_labels_learn_from_wider_domains(spark):
    rules = (("block", "a.net", "/spam/"), ("allow", "b.net", "/news/"), ("block", "c.net", "/mixed/"), ("allow", "d.net", "/mixed/"))
    rows = [(f"http://{h}.net/{s}/{i}",) for h, s in (("a", "spam"), ("b", "news"), ("c", "mixed"), ("d", "mixed")) for i in range(60)]
    rows += [(f"http://x.{d}/{s}/{i}",) for d in ("net", "org") for s in ("spam", "news", "mixed", "other") for i in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string")
    got = {(r["host"], r["path"].split("/")[1]): (r["verdict"], r["purity"]) for r in judge_urls(df, rules).collect() if r["host"].startswith("x.")}
    assert {k: v[0] for k, v in got.items()} == {(f"x.{d}", s): "block" if s == "spam" else "allow" for d in ("net", "org") for s in ("spam", "news", "mixed", "other")}
    top = (60 + 2) / 64
    near = (60 + 4 * (0.5 + 0.9 * (top - 0.5))) / 64
    assert got["x.net", "spam"][1] == pytest.approx(0.5 + 0.9 * (near - 0.5)) and got["x.org", "other"][1] == 0.5
    assert got["x.org", "spam"][1] == pytest.approx(0.5 + 0.9**2 * (top - 0.5)) and got["x.org", "spam"][1] < got["x.net", "spam"][1]


def test_siblings_merge_unless_their_labels_differ(spark):
    rules = (("block", "h.net", "/a/"), ("block", "h.net", "/b/"), ("allow", "h.net", "/c/"), ("block", "h.net", "/d/"))
    rows = [f"http://h.net/{s}/{i}" for s, n in (("a", 90), ("b", 80), ("c", 9), ("d", 1), ("e", 5)) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["path"].split("/")[1]: r["template"] for r in judge_urls(df, rules).collect()}
    assert got == {"a": "/+/{n}", "b": "/+/{n}", "c": "/c/{n}", "d": "/+/{n}", "e": "/e/{n}"}


def plain_spans(text):
    """The base patterns as plain regexes."""
    found = []
    for kind, (name, p) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            checks = {"email": lambda t, d: True, "ip": lambda t, d: all(int(x) <= 255 for x in t.split(".")), "card": lambda t, d, luhn=luhn: 12 <= len(d) <= 19 and luhn, "phone": lambda t, d: 9 <= len(d) <= 15}
            if checks[name](m[0], d):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_plain_regexes():
    rng = random.Random(6)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (619) 555-0053", "+49", "é", " ", ".", "-", "12", "000.0.0.0255", "a@b.c@d.e", "9" * 30, "a-b.c@d-.e-"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert base_spans(t) == plain_spans(t), t
    assert base_spans("1" * 200_000 + "a." * 1000) == []


def test_pii_digest_and_contexts(spark):
    docs = [(i, f"my password={i:04d}abcd{i:06d} and mail me.{i}@site.org") for i in range(40)]
    docs += [(200 + i, f"{'one two three four five'.split()[i % 5]} token: Zq{i:02d}xTT{i % 10}aa91 ok") for i in range(50)] + [(300, "a lone api_key: Qq81-1234567 here")]
    docs += [(100, "here token: Zq81xTT0aa91 ok"), (101, None), (102, ""), (103, "plain words only"), (104, "ü 1.2.3.4, ref 20250101x"), (105, "\U0001f600 a@b.cc"), (105, "\U0001f600 a@b.cc")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, base long")
    rows = {r["doc_id"]: r for r in digest(find_pii(df)).collect()}
    assert len(digest(find_pii(df)).collect()) == len(docs)
    assert rows[7]["n_email"] == 1 and rows[7]["spans"].startswith("id:12:26,email:")
    assert rows[100]["spans"] == "id:12:24" and rows[100]["n_card"] == 0
    assert [rows[i]["spans"] for i in (101, 102, 103)] == [""] * 3
    assert rows[300]["spans"] == ""  # a seed without support is no finding
    assert rows[102]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[104]["spans"] == "ip:2:9" and rows[105]["spans"] == "email:2:8"
    assert rows[104]["base_sha256"] == hashlib.sha256(b"ip:2:9").hexdigest()
    text = {r["doc_id"]: r["text"] for r in redacted(df).collect()}
    assert text[7] == "my password=[ID] and mail [EMAIL]" and text[103] == "plain words only" and text[101] is None
    assert find_pii(df.limit(0)).count() == 0


def badge_docs():
    """Contexts that stand in no list: three quarters of the badges are tokens elsewhere, telephones stand where phones do."""
    rng = random.Random(8)
    words = ["red", "house", "over", "runs", "lake", "and", "green", "hill"]
    around = lambda x: " ".join([*rng.choices(words, k=4), x, *rng.choices(words, k=4)])
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(23)) + "a"
    codes = [code() for _ in range(40)]
    docs = [around(f'token = "{c}"') for c in codes[:30]] + [around(f"badge <{c}>") for c in codes]
    docs += [around(f"please ring +1 (619) 555-{1000 + i}") for i in range(30)] + [around(f"please ring 555-{1000 + i}") for i in range(10)]
    docs += [around(f"item {20_000_000 + i}") for i in range(40)] + [around(str(20_000_000 + i)) for i in range(40)]
    return docs


def plain_bootstrap(texts, rounds, support=3, doubt=2.0):
    edges: dict = {}
    labels: dict = {}
    for t in texts:
        for p, c, v, known, seed in edges_of(t):
            edges[p, v] = edges.get((p, v), False) or c
            old = labels.get(v, (None, False))
            labels[v] = (old[0] if known is None else known if old[0] is None else min(known, old[0]), old[1] or seed)
    edges = {(p, v): (c, *labels[v]) for (p, v), c in edges.items()}
    by_p: dict = {}
    for (p, v), e in edges.items():
        by_p.setdefault(p, {})[v] = e
    by_p = {p: vs for p, vs in by_p.items() if len(vs) >= support}
    by_v: dict = {}
    for p, vs in by_p.items():
        for v, e in vs.items():
            if e[1] is None:
                by_v.setdefault(v, set()).add(p)
    conf = {p: [sum(e[1] == k or (e[1] is None and e[2] and k == 4) for e in vs.values()) / (len(vs) + doubt) for k in range(5)] for p, vs in by_p.items()}
    for _ in range(rounds - 1):
        new = {}
        for p, vs in by_p.items():
            sums = [0.0] * 5
            for v, e in vs.items():
                for k in range(5):
                    if e[1] is not None:
                        sums[k] += e[1] == k
                    else:
                        miss = 1.0
                        for q in by_v[v] - {p}:
                            miss *= 1 - min(conf[q][k], 0.999)
                        sums[k] += 1 - miss
            new[p] = [x / (len(vs) + doubt) for x in sums]
        conf = new
    context = {p for p, vs in by_p.items() if any(e[0] for e in vs.values())}
    return {p: max((c[k], -k) for k in range(5)) for p, c in conf.items() if p in context}


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_bootstrap_equals_a_plain_iteration(spark, rounds):
    texts = [*badge_docs(), None, "", "a 12345678", "mail a1234567@b.cc 12345678 and token: 12345678"]
    df = spark.createDataFrame([(t,) for t in texts + texts[:20]], "text string")
    got = {r["pattern"]: (r["confidence"], -r["kind"]) for r in bootstrap(graph_rows(df), rounds).collect()}
    want = plain_bootstrap(texts, rounds)
    assert got.keys() == want.keys()
    for p in want:
        assert abs(got[p][0] - want[p][0]) < 1e-9
        assert got[p][1] == want[p][1] or abs(got[p][0] - want[p][0]) < 1e-12
    assert bootstrap(graph_rows(df.limit(0)), rounds).count() == 0


def test_unlisted_contexts_are_learnt(spark):
    docs = badge_docs()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(docs)], "doc_id long, text string, found string")
    rows = {r["doc_id"]: r for r in find_pii(df).collect()}
    kinds = lambda a, b: [[s["kind"] for s in rows[i]["found"]] for i in range(a, b)]
    assert kinds(0, 70) == [["id"]] * 70  # the last ten stand after `badge` only
    assert kinds(100, 110) == [["phone"]] * 10
    assert kinds(110, 190) == [[]] * 80
    s = rows[30]["found"][0]
    assert docs[30][s["start"] - 1] + docs[30][s["end"]] == "<>"
    joined = {r["doc_id"]: r for r in find_pii(df, most_patterns=0).collect()}
    assert joined == rows


def test_entities_of_odd_texts():
    assert tokens("x" * 50_000 + "1" + "é" * 50_000, []) == [(0, 100_001)]
    assert tokens("--12345678__ ab1", []) == [(2, 10)]
    assert tokens("12345678 a@12345678.b 12345678", base_spans("12345678 a@12345678.b 12345678")) == [(0, 8), (22, 30)]
    assert edges_of("1" * 300_000 + " " + "a1," * 50_000) and not edges_of(None) and not edges_of("no digits")
    assert LEARNT[:4] == KINDS and pattern_key("a") != pattern_key("b")
