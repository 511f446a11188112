"""Tokens of two tokenizers aligned by byte offsets, with corpus-wide counts of overlapping ids."""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from spanlake.llm.common import cut, pieces, spread_join, stored
from spanlake.llm.tokens import PATTERN

#: Published vocabularies: byte-level BPE (a Tokenizers file) and BPE with byte fallback (a SentencePiece model).
VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes cut into units at once, and different units remembered by a worker.
PIECE_BYTES, MOST_UNITS = 4 << 20, 300_000
#: Longer units are encoded each time.
LONGEST_KEPT = 64
#: Last bytes of the white space beyond ASCII, after which no unit may begin.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Tokenizer A: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, letters = path, _byte_letters()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        pre = model["pre_tokenizer"]
        # ids in the order of merges and the usual pre-tokenisation: then ranks give the same tokens, four times as fast
        ordered = all(model["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered and plain else None
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.asarray(self.fast.encode_to_numpy(text), np.int64)
            except BaseException as e:  # noqa: BLE001  the regex engine gives up on very long runs of white space, partly by a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class PieceBpe:
    """Tokenizer B, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece has a space behind another character, so that no token crosses the beginning of a run of spaces.
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units, each of which begins with the space that the model puts there itself (but not before an empty text)."""
        space = [self.model.piece_to_id("▁")]
        return [ids or space for ids in self.model.encode([u[1:] for u in units], num_threads=1)]


def coalesce(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all A tokens and of all B tokens, numbered from 0.

    Tokens of both kinds are sorted by start; a group breaks where a start reaches the running
    maximum of the ends before it, which is where tokens of both kinds end.
    """
    starts, ends = np.concatenate((starts_a, starts_b)), np.concatenate((ends_a, ends_b))
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate(([0], starts[order][1:] >= reached[:-1])).astype(np.int64)
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(starts_a)], group[len(starts_a) :]


def overlaps(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index of an A token, index of a B token) whose ranges overlap; each kind's tokens follow each other."""
    first, beyond = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    n = np.maximum(beyond - first, 0)
    a = np.repeat(np.arange(len(starts_a)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Where units of ' ' + text begin: at its start, and at spaces behind what surely is no white space.

    Neither tokenizer has a token that crosses such a place, and what it makes of a unit doesn't depend
    on the others.
    """
    before = raw[:-1]
    fit = (raw[1:] == 0x20) & (before > 0x20) & (before != 0x7F)
    wide = np.flatnonzero(fit & (before >= 0x80)) + 1
    for at in wide[np.isin(raw[wide - 1], [w[-1] for w in _WIDE_SPACES])]:
        if raw[max(0, at - 3) : at].tobytes().endswith(tuple(_WIDE_SPACES)):
            fit[at - 1] = False
    return np.concatenate(([0], np.flatnonzero(fit) + 1))


class Aligner:
    """Encodes and aligns units of text once for all their occurrences that a worker meets."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.size = np.array([len(t) for t in self.a.bytes], np.int64), np.array([len(t) for t in self.b.bytes], np.int64)
        self.names = [[str(i) + s for i in range(max(len(self.a.bytes), len(self.b.bytes)))] for s in (",", "|", ";")]
        self.span, self.pair_span = len(self.b.bytes), len(self.a.bytes) * len(self.b.bytes)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.n = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at, self.ends_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def codes(self, units: list[bytes]) -> np.ndarray:
        """Numbers of units; what isn't known yet is encoded."""
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def forget(self) -> None:
        """Start anew when much is remembered; long units don't stay."""
        if len(self.known) > MOST_UNITS or any(len(u) > LONGEST_KEPT for u in self.known):
            self.clear()

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units by A and by B, one unit after the other."""
        a, i = [], 0
        while i < len(units):  # units that end in something visible may be encoded together
            j = i + 1
            while j < len(units) and j - i < 20_000 and self.b.splits and not units[j - 1][-1].isspace():
                j += 1
            a.append(self.a.encode("".join(units[i:j])))
            i = j
        b = self.b.encode(units)
        return np.concatenate(a), np.fromiter((i for ids in b for i in ids), np.int64)

    def _learn(self, new: list[bytes]) -> None:
        texts, bad = [], []
        for i, u in enumerate(new):
            try:
                texts.append(u.decode())
            except UnicodeDecodeError:
                texts.append(" ")
                bad.append(i)
        a, b = self._encoded(texts)
        good = np.ones(len(new), bool)
        stops = np.cumsum([len(u) for u in new])
        spelled = b"".join(new)
        if bad or any(b"".join(map(t.bytes.__getitem__, ids.tolist())) != spelled for t, ids in ((self.a, a), (self.b, b))):
            kept_a, kept_b = [], []  # some unit can't be spelled by both: look at each
            for i, t in enumerate(texts):
                own = self._encoded([t])
                good[i] = i not in bad and all(b"".join(map(k.bytes.__getitem__, ids.tolist())) == new[i] for k, ids in ((self.a, own[0]), (self.b, own[1])))
                if good[i]:
                    kept_a.append(own[0])
                    kept_b.append(own[1])
            none = [np.zeros(0, np.int64)]
            a, b = np.concatenate(kept_a or none), np.concatenate(kept_b or none)
            stops = np.cumsum(np.where(good, [len(u) for u in new], 0))
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        starts_a, starts_b = ends_a - self.size[0][a], ends_b - self.size[1][b]
        group_a, group_b = coalesce(starts_a, ends_a, starts_b, ends_b)
        link_a, link_b = overlaps(starts_a, ends_a, starts_b, ends_b)
        unit = np.arange(len(new))
        of_a, of_b = np.searchsorted(stops, starts_a, "right"), np.searchsorted(stops, starts_b, "right")
        last = np.flatnonzero(np.diff(np.concatenate((group_a, [-1]))))  # each group's last A token
        of_group, of_link = of_a[last], of_a[link_a]
        n = np.stack([np.bincount(x, minlength=len(unit)) for x in (of_a, of_b, of_group, of_link)], axis=1)
        self.text += self._spelled(a, b, group_a, group_b, of_a, of_b, len(new))
        self.known.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
        self.good, self.n = np.concatenate((self.good, good)), np.concatenate((self.n, n))
        self.pairs = np.concatenate((self.pairs, a[link_a] * self.span + b[link_b]))
        began = np.concatenate(([0], stops[:-1]))
        self.ends = np.concatenate((self.ends, ends_a[last] - began[of_group]))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n[:, 3])))
        self.ends_at = np.concatenate((self.ends_at, self.ends_at[-1] + np.cumsum(n[:, 2])))

    def _spelled(self, a, b, group_a, group_b, of_a, of_b, units: int) -> list[str]:
        """Each unit's groups as `a1,a2|b1;a3|b2,b3`."""
        if not len(a):
            return [""] * units
        ids, group, unit = np.concatenate((a, b)), np.concatenate((group_a, group_b)), np.concatenate((of_a, of_b))
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(ids)), side, group))
        group, side, unit = group[order], side[order], unit[order]
        mark = np.where(np.diff(group, append=-1) != 0, 2, np.diff(side, append=0) != 0)
        comma, bar, semicolon = self.names
        parts = [(comma, bar, semicolon)[m][i] for i, m in zip(ids[order].tolist(), mark.tolist(), strict=True)]
        whole = "".join(parts)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        cuts = at[np.searchsorted(unit, np.arange(units + 1))].tolist()
        return [whole[i : max(i, j - 1)] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def units(self, text: bytes) -> list[bytes]:
        whole = b" " + text
        if not self.b.splits:
            return [whole]
        at = unit_starts(np.frombuffer(whole, np.uint8)).tolist()
        return [whole[i:j] for i, j in zip(at, [*at[1:], len(whole)], strict=True)]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, groups: bool = False) -> DataFrame:
    """(doc_id, text) -> for each row doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links of its
    tokens as pairs array<long> (A id x B's vocabulary size + B id, distinct) and counts array<long>; with
    `groups` also the groups (`a1,a2|b1;a3|b2,b3`) and their ends in bytes of the text.

    A encodes a space and the text, B the text, before which it puts a space itself; special tokens'
    names are ordinary text. Texts that are null, empty, no UTF-8, or that either can't spell (B
    reads U+2581 as a space) have no tokens: zeros, '' and empty arrays. Every row counts, repeated ones
    too; other columns are ignored.

    A text is cut into units at spaces behind visible characters, where no token of either can cross.
    A worker encodes each different unit once and remembers it, up to a bound; tokens and groups are
    those of the whole text. Texts are worked through in pieces, so a long one needs no more memory
    than its distinct pairs (and, if asked for, its groups). The vocabulary files have to be at
    their paths on every executor.
    """

    def align(batches):
        know = aligner(vocabulary_a, vocabulary_b)
        for batch in pieces(batches, 1, 2 * PIECE_BYTES):
            rows = batch.num_rows
            n, bad = np.zeros((rows, 4), np.int64), np.zeros(rows, bool)
            shas, seen = [None] * rows, [[] for _ in range(rows)]
            spelled, ends, length = [[] for _ in range(rows)], [[] for _ in range(rows)], [0] * rows
            held: list[tuple[int, list[bytes]]] = []

            def work(held=held, n=n, bad=bad, shas=shas, seen=seen, spelled=spelled, ends=ends, length=length):
                know.forget()
                codes = know.codes([u for _, units in held for u in units])
                size = np.array([len(units) for _, units in held])
                stop = np.cumsum(size)
                row = np.array([r for r, _ in held])
                np.logical_or.at(bad, row, ~np.logical_and.reduceat(know.good[codes], stop - size))
                np.add.at(n, row, np.add.reduceat(know.n[codes], stop - size))
                links = know.n[codes, 3]
                flat = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links - know.at[codes], links)
                key, count = np.unique(np.repeat(np.repeat(np.arange(len(held)), size), links) * know.pair_span + know.pairs[flat], return_counts=True)
                cuts = np.searchsorted(key, np.arange(len(held) + 1) * know.pair_span)
                for i, (r, units) in enumerate(held):
                    own = codes[stop[i] - size[i] : stop[i]].tolist()
                    text = ";".join([know.text[c] for c in own])
                    if shas[r] is None:
                        shas[r] = hashlib.sha256(text.encode())
                    else:
                        shas[r].update(b";" + text.encode())
                    seen[r].append((key[cuts[i] : cuts[i + 1]] - i * know.pair_span, count[cuts[i] : cuts[i + 1]]))
                    if groups:
                        spelled[r].append(text)
                        for c, u in zip(own, units, strict=True):
                            ends[r].append(know.ends[know.ends_at[c] : know.ends_at[c] + know.n[c, 2]] + length[r] - 1)
                            length[r] += len(u)
                held.clear()

            size = 0
            for r, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    bad[r] = True
                    continue
                units, at, begin = know.units(text), 0, 0
                for i, u in enumerate(units):
                    at += len(u)
                    if size + at > PIECE_BYTES and i >= begin:
                        held.append((r, units[begin : i + 1]))
                        work()
                        size, at, begin = 0, 0, i + 1
                if begin < len(units):
                    held.append((r, units[begin:]))
                    size += at
            if held:
                work()
            n[bad] = 0
            pairs, counts, offsets = [], [], [0]
            for r in range(rows):
                if bad[r]:
                    seen[r] = []
                if len(seen[r]) > 1:
                    key, back = np.unique(np.concatenate([p for p, _ in seen[r]]), return_inverse=True)
                    seen[r] = [(key, np.bincount(back, np.concatenate([c for _, c in seen[r]])).astype(np.int64))]
                for p, c in seen[r]:
                    pairs.append(p)
                    counts.append(c)
                offsets.append(offsets[-1] + sum(len(p) for p, _ in seen[r]))
            none = [np.zeros(0, np.int64)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x or none).astype(np.int64))) for x in (pairs, counts)]
            out = [batch.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(["" if bad[r] else shas[r].hexdigest() for r in range(rows)], pa.string()), *lists]
            if groups:
                out += [pa.array(["" if bad[r] else ";".join(spelled[r]) for r in range(rows)], pa.string())]
                out += [pa.array([[] if bad[r] else np.concatenate(ends[r]).tolist() for r in range(rows)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = docs.select("doc_id").schema
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(c, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", ArrayType(LongType())).add("counts", ArrayType(LongType()))
    if groups:
        schema = schema.add("groups", "string").add("ends", ArrayType(LongType()))
    names = schema.names
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(align, schema)


def cross_tokenizer(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, most_pairs: int = 2_000_000) -> DataFrame:
    """`aligned` with n_best and count_sum of each row's links, by the corpus-wide counts of their id pairs.

    A link counts to n_best if no other A id has more links with its B id. The alignment is written out
    once; counts are summed from it. Counts of up to `most_pairs` pairs of ids go to every task, more
    are joined by pair, frequent pairs spread over tasks. An empty table gives no rows.
    """
    rows = stored(aligned(docs, vocabulary_a, vocabulary_b).withColumn("row", F.monotonically_increasing_id()))
    span = F.lit(len(PieceBpe(vocabulary_b).bytes)).cast("long")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.counts").alias("n"))
    totals = cut(links.groupBy("pair").agg(F.sum("n").alias("total"), F.count("*").alias("rows")))
    best = totals.groupBy((F.col("pair") % span).alias("b")).agg(F.max("total").alias("most"))
    known = totals.withColumn("b", F.col("pair") % span).join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"), "rows")
    size, entries = totals.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if size <= most_pairs:
        met = links.join(F.broadcast(known.drop("rows")), "pair")
    else:
        hot = known.filter(F.col("rows") * 1000 >= entries).select("pair", F.expr(f"cast(rows * 1000 div {entries} + 1 as int)").alias("__parts"))
        met = spread_join(links, known.drop("rows"), ["pair"], hot=hot)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "counts").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
