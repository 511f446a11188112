"""Reading, lineage cutting and vectorised word handling shared by the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; one longer document is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that nothing is learnt from; a null id is held out too."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spanlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute a small table once and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A computed (cut or stored) table in as few partitions as its rows need, so that later shuffles of it write few files."""
    return df.coalesce(df.count() // rows + 1)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A table written into the shared folder, read again, and its path."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/spanlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a larger table once into the shared folder and go on from the files."""
    return written(df)[0]


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """Like `stored`, but the files go at the end; what is needed of them has to be computed by then."""
    out, path = written(df)
    try:
        yield out
    finally:
        deleted(df.sparkSession, path)


def _parted(rows: DataFrame, key: str, ids: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows that hit none of the ids' bits, and the others. The bits go to every task."""
    n = ids.count()
    size = min(max(16, (64 * n).bit_length()), most_bits)
    slot, bit = F.expr(f"pmod(xxhash64({key}), {1 << size})"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {1 << size}) % 64 as int))")
    words = ids.select(F.floor(slot / 64).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    tested = rows.withColumn("__word", F.floor(slot / 64)).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)) & F.col(key).isNotNull()
    return tested.filter(~hit).drop("__word", "__bits"), tested.filter(hit).drop("__word", "__bits")


def without(rows: DataFrame, key: str, ids: DataFrame, most_bits: int = 26) -> DataFrame:
    """The rows whose `key` isn't among the distinct, non-null `ids` (a column of the same name); null keys stay.

    A bit for each hashed id goes to every task (2**most_bits bits at most, 64 for an id before that):
    rows that hit none are kept where they are, and only the others move to meet the ids.
    """
    ids = cut(ids.select(key))
    clear, others = _parted(rows, key, ids, most_bits)
    return clear.unionByName(others.join(ids, key, "left_anti"))


def within(rows: DataFrame, key: str, ids: DataFrame, most_bits: int = 26) -> DataFrame:
    """The rows whose `key` is among the distinct `ids`; those that hit none of their bits don't move, see `without`."""
    ids = cut(ids.select(key))
    return _parted(rows, key, ids, most_bits)[1].join(ids, key, "left_semi")


def hot_keys(many: DataFrame, keys: list[str], parts: int = 1000, least: int = 1000) -> DataFrame:
    """The non-null keys with over 1/parts of the rows of a cut or stored table, and `__parts`, how often that is.

    By arithmetic they are no more than `parts`, so the list may go to every task. Keys with up to
    `least` rows aren't worth splitting, unless the rows are large.
    """
    held = many.groupBy(*keys).agg(F.count("*").alias("__n"))
    share = held.crossJoin(F.broadcast(many.groupBy().agg(F.count("*").alias("__all")))).filter(F.col("__n") * parts >= F.col("__all"))
    share = share.filter((F.col("__n") > least) & F.col(keys[0]).isNotNull())
    return share.select(*keys, F.expr(f"cast(__n * {parts} div __all + 1 as int)").alias("__parts"))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """many join few, with the hot keys of `many` split over several tasks (AQE splits a partition by its size only).

    Rows of `few` with a hot key are repeated for each of its shares. `many` is counted first, unless
    its hot_keys are given; hand in a cut or stored table. `how` may be inner or left. Null keys match
    nothing; in a left join they are spread as well.
    """
    hot = F.broadcast(hot_keys(many, keys) if hot is None else hot)
    wide = few.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    others = [c for c in many.columns if c not in keys]
    rows = F.xxhash64(*([c for c in others if many.schema[c].dataType.typeName() not in ("array", "map", "struct")] or others))
    part = F.pmod(rows, F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")
    if how == "left":
        part = F.when(F.col(keys[0]).isNull(), F.pmod(rows, F.lit(1000)).cast("int")).otherwise(part)
    return many.join(hot, keys, "left").withColumn("__part", part).drop("__parts").join(wide, [*keys, "__part"], how).drop("__part")


# --- vectorised words -------------------------------------------------------

#: [\x20\x09-\x0D]
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: The same and all other ASCII that is neither letter nor digit.
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def combined(parts: list[np.ndarray], tag: int) -> np.ndarray:
    """One hash of several aligned hashes, dependent on their order."""
    out = np.full(len(parts[0]), np.uint64(tag), np.uint64)
    for p in parts:
        out = (out ^ p) * _A
        out ^= out >> np.uint64(29)
    return mixed(out)


class Words:
    """Words of several texts: a 64-bit hash each, and where each text's words begin."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = SPACES):
        self.buf = b"\n".join([*texts, b""]).lower()
        raw = np.frombuffer(self.buf, np.uint8)
        gap = breaks[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, at)
        self.offsets = at
        self.hashes = self._hash(raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))
        size = self.ends - self.starts
        h = mixed((lanes[self.starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _A)
        done, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            left = size[rest] - done
            h[rest] = mixed((h[rest] * _A) ^ (lanes[self.starts[rest] + done] & _MASKS[np.minimum(left, 8)]))
            done += 8
            rest = rest[left > 8]
        return h

    def grams(self, n: int, skip: int = 0) -> np.ndarray:
        """Hashes of n following words (every (skip+1)-th) from each start; some cross texts."""
        step = skip + 1
        k = len(self.hashes) - (n - 1) * step
        if k <= 0:
            return np.zeros(0, np.uint64)
        return combined([self.hashes[i * step : i * step + k] for i in range(n)], n * 64 + skip)

    def text_of(self, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each of grams(n, skip): the text it starts in, and whether it stays there."""
        k = max(0, len(self.hashes) - (n - 1) * (skip + 1))
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return owner[:k], owner[:k] == owner[(n - 1) * (skip + 1) :][:k]


def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about `most` bytes each."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def pieces(batches: Iterator, column: int, most: int = 4 << 20) -> Iterator:
    """Arrow batches in parts that hold about `most` bytes of a string or binary column each: what a task holds at once."""
    for batch in batches:
        size = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for begin, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)
