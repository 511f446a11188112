"""Personal data: exact base patterns, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlake.llm.common import cut, hot_keys, pieces, spread_join

KINDS = ("email", "ip", "card", "phone")
#: All kinds of a pattern; `id` is an identifier or credential that no base pattern describes.
LEARNT = (*KINDS, "id")
#: What stands before a seed entity of kind `id`. It counts in the first round only.
SEED_CONTEXT = re.compile(r"(?:password|passwd|secret|token|api_key)[\"']?[=:][\"']?")
#: Contexts reach over no more punctuation than this between two words.
MARKS = 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where no digit stands before it, which keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_REST = re.compile(r"[\w-]*+")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            last = m.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted; leftmost and non-overlapping for each kind.

    A match that fails its check is dropped and the search goes on behind it.
    """
    out = [(b, 0, e) for b, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, pattern, low, high in ((2, _CARD, 12, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if low <= len(digits) <= high and (kind == 3 or _luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _begin(text: str, at: int, low: int = 0) -> int:
    """Where the run of letters, digits, `_` and `-` that ends at `at` begins."""
    while at > low and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return at


def contexts(text: str, at: int) -> list[str]:
    """What stands before `at`: the nearest word and the marks after it, and the same from the word before.

    In lower case, without spaces but for one between the words. A longer string of marks ends a context.
    """
    found, left = [], ""
    for _ in range(2):
        marks = 0
        while at and not (text[at - 1].isalnum() or text[at - 1] in "_-"):
            at -= 1
            if not text[at].isspace():
                marks += 1
                if marks > MARKS:
                    return found
                left = text[at] + left
        if not at:
            break
        end, at = at, _begin(text, at)
        left = text[at:end].lower() + left
        found.append(left)
        left = " " + left
    return found


def form(value: str) -> str:
    """A value's length and the classes of its characters: hexadecimal digits alone, or letters by case."""
    if all(c in "0123456789abcdefABCDEF" for c in value) and not value.isdigit():
        return f"{len(value)}:hex"
    return f"{len(value)}:" + "".join(n for n, has in (("a", str.islower), ("A", str.isupper), ("9", str.isdigit), ("-", lambda c: not c.isalnum())) if any(map(has, value)))


def tokens(text: str, spans: list[tuple[int, int, int]], least: int = 8) -> list[tuple[int, int]]:
    """(start, end) of the identifier-like words apart from `spans`: `least` characters or more, and a digit."""
    taken: list[list[int]] = []
    for b, _, e in spans:
        if taken and b < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([b, e])
    out, at, i = [], 0, 0
    while m := _DIGIT.search(text, at):
        begin, end = _begin(text, m.start(), at), _REST.match(text, m.start()).end()
        at = end
        while begin < end and text[begin] in "_-":
            begin += 1
        while end > begin and text[end - 1] in "_-":
            end -= 1
        while i < len(taken) and taken[i][1] <= begin:
            i += 1
        if end - begin >= least and not (i < len(taken) and taken[i][0] < end):
            out.append((begin, end))
    return out


def _key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def pattern_key(context: str) -> int:
    """The number that stands for a context in the graph."""
    return _key(f"before {context}")


def edges_of(text: str | None) -> set[tuple[int, bool, int, int | None, bool]]:
    """(pattern, is a context, value, base kind or None, is a seed of kind `id`) of a text's entities.

    Entities are the base spans and the identifier-like words apart from them. A value's patterns are
    its contexts and its form.
    """
    if not text or not _HINT.search(text):
        return set()
    base = base_spans(text)
    out = set()
    for b, e, kind in [*((b, e, k) for b, k, e in base), *((b, e, None) for b, e in tokens(text, base))]:
        near, value = contexts(text, b), _key(text[b:e])
        seed = kind is None and bool(near and SEED_CONTEXT.fullmatch(near[0]))
        out |= {(pattern_key(c), True, value, kind, seed) for c in near}
        out.add((_key(f"form {form(text[b:e])}"), False, value, kind, seed))
    return out


def graph_rows(docs: DataFrame) -> DataFrame:
    """edges_of the texts: pattern, context, value, known, seed; once for each Arrow batch and tuple."""

    def scan(batches):
        for batch in pieces(batches, 0):
            rows = set().union(*map(edges_of, batch.column(0).to_pylist()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["pattern", "context", "value", "known", "seed"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "pattern long, context boolean, value long, known int, seed boolean")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def bootstrap(rows: DataFrame, rounds: int = 3, support: int = 3, doubt: float = 2.0) -> DataFrame:
    """graph_rows -> (pattern, kind number, confidence): each context's best kind in the pattern-instance graph.

    Seed entities start: base spans are known, of their kind for good; a value after a credential word
    counts as an `id` in the first round only. A pattern's confidence in a kind is the sum of its values'
    scores for the kind, over their number and `doubt`. From the second round on, a value that isn't known
    scores 1 minus the product of the doubts of its *other* patterns, so no pattern supports itself, and
    credential words keep just the confidence that forms and other contexts give their values. Known
    values of other kinds count as misses. Patterns with under `support` values have no confidence.
    Values count once for each pattern, so copies raise nothing. Ties go to the kind listed first.

    The graph shrinks to the supported patterns before it is joined; patterns and values that hold much
    of it are spread over tasks.
    """
    c, s = ([f"{x}{k}" for k in range(len(LEARNT))] for x in "cs")
    edges = cut(rows.groupBy("pattern", "value").agg(F.max("context").alias("context"), F.min("known").alias("known"), F.max("seed").alias("seed")))
    labels = edges.groupBy("value").agg(F.min("known").alias("known"), F.max("seed").alias("seed")).filter("known is not null or seed")
    held = cut(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.max("context").alias("context")).filter(F.col("n") >= support))
    edges = cut(edges.select("pattern", "value").join(held.select("pattern"), "pattern", "left_semi"))
    hot = {key: hot_keys(edges, [key]) for key in ("pattern", "value")}
    edges = cut(spread_join(edges, labels, ["value"], "left", hot["value"]))
    first = F.coalesce("known", F.when(F.col("seed"), len(KINDS)))
    sums = edges.groupBy("pattern").agg(*(F.sum((x == k).cast("double")).alias(f"{n}{k}") for n, x in (("s", first), ("known", F.col("known"))) for k in range(len(LEARNT))))
    held = cut(held.join(sums, "pattern").na.fill(0.0))
    share = [(F.col(s[k]) / (F.col("n") + doubt)).alias(c[k]) for k in range(len(LEARNT))]
    conf = held.select("pattern", "context", *share)
    open_ = cut(edges.filter("known is null").select("pattern", "value")) if rounds > 1 else None
    doubts = lambda k: F.log1p(-F.least(c[k], F.lit(0.999)))
    for _ in range(rounds - 1):
        both = cut(spread_join(open_, conf.select("pattern", *(doubts(k).alias(c[k]) for k in range(len(LEARNT)))), ["pattern"], hot=hot["pattern"]))
        values = both.groupBy("value").agg(*(F.sum(c[k]).alias(s[k]) for k in range(len(LEARNT))))
        scored = spread_join(both, values, ["value"], hot=hot["value"]).groupBy("pattern").agg(*(F.sum(-F.expm1(F.least(F.col(s[k]) - F.col(c[k]), F.lit(0.0)))).alias(s[k]) for k in range(len(LEARNT))))
        total = held.drop(*s).join(scored, "pattern", "left").na.fill(0.0, s)
        conf = cut(total.select("pattern", "context", *(((F.col(f"known{k}") + F.col(s[k])) / (F.col("n") + doubt)).alias(c[k]) for k in range(len(LEARNT)))))
    best = F.array_max(F.array(*(F.struct(F.col(c[k]).alias("confidence"), F.lit(-k).alias("kind")) for k in range(len(LEARNT)))))
    return conf.filter("context").select("pattern", (-best["kind"]).alias("kind"), best["confidence"].alias("confidence"))


class Patterns:
    """Learnt contexts in sorted arrays, as they go to the tasks."""

    def __init__(self, learnt):
        self.keys, self.kinds, self.sure = (learnt.column(i).to_numpy() for i in range(3))
        order = np.argsort(self.keys)
        self.keys, self.kinds, self.sure = self.keys[order], self.kinds[order], self.sure[order]

    def kind(self, patterns: list[int]) -> int | None:
        """The kind of the surest pattern, ties to the kind listed first; None if none is learnt."""
        at = np.searchsorted(self.keys, patterns)
        got = [(-self.sure[i], int(self.kinds[i])) for i, p in zip(at, patterns, strict=True) if i < len(self.keys) and self.keys[i] == p]
        return min(got)[1] if got else None


def _spanned(docs: DataFrame, rounds: int, confident: float, most_patterns: int) -> DataFrame:
    """row (the whole input row), base and found (arrays of start, kind, end)."""
    learnt = cut(bootstrap(graph_rows(docs), rounds).filter(F.col("confidence") >= confident))
    work = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    by_task = learnt.count() <= most_patterns
    patterns = Patterns(learnt.toArrow()) if by_task else None

    def find(batches):
        named = lambda spans: [{"start": b, "kind": LEARNT[k], "end": e} for b, k, e in spans]
        for batch in pieces(batches, 1):
            base, more = [], []
            for text in batch.column(1).to_pylist():
                hinted = bool(text and _HINT.search(text))
                b = base_spans(text) if hinted else []
                own = [(x, y, [pattern_key(c) for c in contexts(text, x)]) for x, y in tokens(text, b)] if hinted else []
                base.append(named(b))
                if by_task:
                    more.append(named([(x, k, y) for x, y, p in own if p and (k := patterns.kind(p)) is not None]))
                else:
                    more.append([{"start": x, "end": y, "patterns": p} for x, y, p in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(more, _SPANS if by_task else _OPEN)], names=["row", "base", "found"])

    spans = "array<struct<`start`:long,kind:string,`end`:long>>"
    schema = StructType([work.schema["row"], *StructType.fromDDL(f"base {spans}, found {spans if by_task else 'array<struct<`start`:long,`end`:long,patterns:array<long>>>'}")])
    out = work.mapInArrow(find, schema)
    if by_task:
        return out
    # too many patterns for every task: they meet the words of each different text by a join
    text = F.col("row")["text"]
    out = out.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
    words = out.groupBy("h1", "h2").agg(F.first("found").alias("found")).select("h1", "h2", F.explode("found").alias("w")).select("h1", "h2", "w.start", "w.end", F.explode("w.patterns").alias("pattern"))
    hits = spread_join(cut(words), learnt, ["pattern"]).groupBy("h1", "h2", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best"))
    kind = F.element_at(F.array(*map(F.lit, LEARNT)), (1 - F.col("best.kind")).cast("int"))
    hits = hits.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", kind.alias("kind"), "end"))).alias("more"))
    return out.join(hits, ["h1", "h2"], "left").select("row", "base", F.coalesce("more", F.array().cast(spans)).alias("found"))


_OPEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def find_pii(docs: DataFrame, rounds: int = 3, confident: float = 0.8, most_patterns: int = 1_000_000) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base, found (arrays of start, kind, end).

    `base` follows the exact patterns, which the counts are of; `found` adds identifier-like words apart
    from base spans that stand in a context of confidence >= `confident`, with that context's kind.
    Which contexts those are is learnt from all texts (`bootstrap`). A row for each input row, other
    columns are ignored; repeated rows are repeated, null ids stay. Null and empty texts have no spans;
    an empty table gives no rows. Texts of any length are scanned in linear time. The texts are read
    twice, once for the graph and once to apply it. Up to `most_patterns` learnt contexts go to every
    task (17 bytes each); more of them meet the words by a join, with the same result.
    """
    out = _spanned(docs.select("doc_id", "text"), rounds, confident, most_patterns)
    count = lambda k: F.size(F.filter("base", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("row.doc_id", *map(count, KINDS), "base", "found")


def _joined(spans):
    """kind:start:end by start, then kind as listed (found ones last)."""
    order = lambda s: sum((F.when(s["kind"] == k, i).otherwise(0) for i, k in enumerate(LEARNT)), F.lit(0))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(found: DataFrame) -> DataFrame:
    """find_pii's rows with their spans as text."""
    base = _joined(F.col("base"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"))


def redacted(docs: DataFrame, rounds: int = 3, confident: float = 0.8, most_patterns: int = 1_000_000) -> DataFrame:
    """`docs` with each span of find_pii in `text` replaced by its kind in brackets; other columns stay.

    Overlapping spans are replaced as one, by the first one's kind. Where there is an n_chars column,
    it counts changed texts anew. Null texts stay null, rows without spans stay as they are.
    """
    spans = F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    text = F.col("row")["text"].cast("string")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["last"], F.concat(acc["done"], F.array(piece(acc["last"], s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["done"]).alias("done"),
        F.greatest(acc["last"], -s["back"]).alias("last"),
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).cast("long").alias("last"))
    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["done"], ""), piece(acc["last"], F.length(text))))
    changed = F.size(spans) > 0
    out = _spanned(docs, rounds, confident, most_patterns).withColumn("new", F.when(changed, joined).otherwise(text)).withColumn("changed", changed)
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*(own[c].alias(c) for c in docs.columns))
