"""Substring search between two tables by hashes of substrings, in equi-joins only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import CHUNK_BYTES, mixed
from spanlake.operators.graph import cut

#: Most lengths that are looked up as they are, most needles that go to every task, bits of the filter.
LENGTHS, FEW, LEAST_BITS, MOST_BITS = 64, 100_000, 16, 28
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Hashes:
    """Two 64-bit hashes of every substring of a length, from sums of bytes' codes times powers of an odd number."""

    def __init__(self, data: np.ndarray):
        self.sums, self.back = [], []
        for base in _BASES:
            powers = [np.cumprod(np.append(np.uint64(1), np.full(len(data), b, np.uint64))) for b in (base, pow(base, -1, 1 << 64))]
            codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[data] * powers[0][:-1], dtype=np.uint64)]))
            self.back.append(powers[1])

    def of(self, which: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """The substrings that begin at `at`, or all of them."""
        s, b = self.sums[which], self.back[which]
        h = (s[length:] - s[: len(s) - length]) * b[: len(s) - length] if at is None else (s[at + length] - s[at]) * b[at]
        return h ^ np.uint64(length * 0x2545F4914F6CDD1D % (1 << 64))


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)


def _floor(length: int) -> int:
    """The largest of 1, 2, 3, 4, 6, 8, 12, ... that isn't over the length."""
    power = 1 << max(0, length.bit_length() - 1)
    return power + power // 2 if length >= power + power // 2 and power > 1 else power if length else 0


def _hashed(needles: DataFrame, exact: bool) -> DataFrame:
    """needle, end, n, h, g: lengths and hashes of each needle's first n bytes, and unless they are all of it, of its last ones."""

    def hashes(frames):
        for pdf in frames:
            rows = []
            for needle in pdf["needle"]:
                b = np.frombuffer(needle.encode(), np.uint8)
                n, made = len(b) if exact else _floor(len(b)), Hashes(b)
                for end, at in ((0, 0), (1, len(b) - n)) if n < len(b) else ((0, 0),):
                    rows.append((needle, end, n, *(int(made.of(k, n, np.array([at]))[0].view(np.int64)) for k in (0, 1))))
            yield pd.DataFrame(rows, columns=["needle", "end", "n", "h", "g"])

    return needles.mapInPandas(hashes, "needle string, end int, n int, h long, g long")


def holders(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """`needle`, and the other columns of `texts`, of each text that holds the needle; once for each of the texts' rows. Nulls meet nothing.

    Needles are looked up by two 64-bit hashes, among those of the texts' substrings of the needles' lengths, of which a
    filter of bits (32 MB at most) lets only likely ones pass: texts don't move. With over `LENGTHS` different
    lengths, a needle's first or last bytes are looked up (two thirds of it or more; those that fewer needles share), and
    such texts are then compared.
    """
    asked = cut(needles.filter(F.col(needle).isNotNull()).select(F.col(needle).alias("needle")).distinct())
    lengths = [r[0] for r in asked.select(F.octet_length("needle")).distinct().limit(LENGTHS + 1).collect()]
    others = [c for c in texts.columns if c != text]
    texts = texts.filter(F.col(text).isNotNull())
    if len(lengths) > LENGTHS:
        longest = texts.agg(F.max(F.octet_length(text))).first()[0] or 0
        asked = asked.filter(F.octet_length("needle") <= longest)
        lengths = [r[0] for r in asked.select(F.octet_length("needle")).distinct().limit(LENGTHS + 1).collect()]
    exact = len(lengths) <= LENGTHS
    keys = cut(_hashed(asked, exact))
    if not exact:
        rare = keys.groupBy("h", "g").agg(F.count("*").alias("shared")).join(keys, ["h", "g"])
        keys = cut(rare.groupBy("needle").agg(F.min(F.struct("shared", "end", "n", "h", "g")).alias("k")).select("needle", "k.*").drop("shared"))
    count, lengths = keys.count(), sorted(r[0] for r in keys.select("n").distinct().collect())
    bits = min(MOST_BITS, max(LEAST_BITS, count.bit_length() + 12))
    filled = np.zeros(1 << bits >> 3, np.uint8)

    def words(frames):
        for pdf in frames:
            place = _place(pdf["h"].to_numpy().view(np.uint64), bits).astype(np.int64)
            yield pd.DataFrame({"byte": place >> 3, "bit": 1 << (place & 7)})

    marked = keys.select("h").mapInPandas(words, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    filled[marked["byte"].to_numpy(np.int64)] = marked["bit"].to_numpy(np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(filled)

    def met(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of texts, and both hashes of what passes in them."""
        data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        made, ends = Hashes(data), np.cumsum(sizes)
        row = np.repeat(np.arange(len(parts)), sizes)
        found = []
        for n in lengths:
            if n == 0:
                at, owner = np.zeros(len(parts), np.int64), np.arange(len(parts))
            else:
                place = _place(made.of(0, n), bits) if n <= len(data) else np.zeros(0, np.uint64)
                at = np.flatnonzero(sent.value[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                owner = row[at]
                inside = at + n <= ends[owner]
                at, owner = at[inside], owner[inside]
            found.append((owner, made.of(0, n, at), made.of(1, n, at)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def look(frames):
        for pdf in frames:
            values = pdf["__text"].to_list()
            stops, size = [0], 0
            for i, v in enumerate(values):
                size += len(v)
                if size >= CHUNK_BYTES or i == len(values) - 1:
                    stops.append(i + 1)
                    size = 0
            for lo, hi in zip(stops, stops[1:], strict=False):
                owner, h, g = met(values[lo:hi])
                hits = pd.DataFrame({"row": owner + lo, "__h": h.view(np.int64), "__g": g.view(np.int64)}).drop_duplicates()
                yield pdf[kept].iloc[hits["row"].to_numpy()].assign(__h=hits["__h"].to_numpy(), __g=hits["__g"].to_numpy())

    rows = texts.select(*others, *([] if exact else [F.xxhash64(text).alias("__own")]), F.col(text).cast("binary").alias("__text"))
    kept = [c for c in rows.columns if c != "__text"]
    if not lengths:
        return rows.select(F.lit("").alias(needle), *others).limit(0)
    schema = rows.select(*kept, F.lit(0).cast("long").alias("__h"), F.lit(0).cast("long").alias("__g")).schema
    keys = keys.select(F.col("needle").alias("__needle"), F.col("h").alias("__h"), F.col("g").alias("__g"))
    hits = rows.mapInPandas(look, schema).join(F.broadcast(keys) if count <= FEW else keys, ["__h", "__g"])
    if not exact:
        hits = hits.join(texts.select(F.xxhash64(text).alias("__own"), F.col(text).alias("__text")).dropDuplicates(["__own"]), "__own").filter(F.contains("__text", "__needle"))
    return hits.select(F.col("__needle").alias(needle), *others)


def containing(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """The different (needle, text) of which the text holds the needle, for short texts; see `holders`."""
    held = texts.select(F.col(text).alias("__held"), F.col(text).alias("__text")).distinct()
    return holders(needles, held, needle, "__text").withColumnRenamed("__held", text)
