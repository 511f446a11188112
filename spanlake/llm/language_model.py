"""Log-likelihoods of whole documents by a gated recurrent network over classes of words, beside smoothed word counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from spanlake.llm.common import Words, chunks, cut, encoded, pieces, spread_join, stored
from spanlake.llm.recurrent import Adam, Recurrent, score, train

#: What is added to a word's count.
PSEUDO = 0.1


def tenth(doc_id: str | Column = "doc_id") -> Column:
    """True for the tenth of the ids that nothing is learnt from; a null id is held out too."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 10 == 0, F.lit(True))


def _ending(w: Words) -> np.ndarray:
    """The last two bytes of each word as a number."""
    raw = np.frombuffer(w.buf, np.uint8)
    last = raw[w.ends - 1].astype(np.int64)
    return np.where(w.ends - w.starts > 1, raw[np.maximum(w.ends - 2, 0)].astype(np.int64) << 8, 0) | last


def word_counts(docs: DataFrame) -> DataFrame:
    """(text) -> word (64-bit hash of a lower-cased word), n, ending (its last two bytes): counts over all rows."""

    def count(batches):
        for batch in batches:
            texts = encoded(batch.column(0))
            parts = []
            for lo, hi in chunks(texts, 8 << 20):
                w = Words(texts[lo:hi])
                word, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                parts.append((word, n, _ending(w)[first]))
            if parts:
                word, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(np.concatenate([p[2] for p in parts])[first])], names=["word", "n", "ending"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long, ending long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))


@dataclass
class Vocabulary:
    """Outputs of the network: frequent words in classes of like frequency, all others in classes by their ending."""

    words: np.ndarray  # hashes of the frequent words, in the order of their numbers
    word_class: np.ndarray
    word_mass: np.ndarray
    class_mass: np.ndarray  # of the frequent words' classes, of the endings' classes, of the end
    ending_class: np.ndarray  # of each possible ending
    log_total: np.ndarray  # log10 of an ending class's smoothed total
    total: int  # tokens, ends included
    distinct: int
    texts: int

    def __post_init__(self):
        self.heads = len(self.class_mass) - len(self.log_total) - 1
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]
        self.log_all = math.log10(self.total + PSEUDO * (self.distinct + 1))

    def coded(self, word: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input symbol, class, and number among the frequent words (-1: none) of words."""
        at = np.minimum(np.searchsorted(self.sorted, word), max(0, len(self.sorted) - 1))
        own = self.order[at] if len(self.sorted) else at
        known = self.sorted[at] == word if len(self.sorted) else np.zeros(len(word), bool)
        classes = np.where(known, self.word_class[own] if len(self.sorted) else 0, self.ending_class[ending])
        return np.where(known, own, len(self.words) + classes - self.heads), classes, np.where(known, own, -1)

    @property
    def kind(self) -> type:
        """What a symbol is stored as."""
        return np.uint16 if self.end[0] < 1 << 16 else np.uint32

    @property
    def end(self) -> tuple[int, int]:
        """Input symbol and class of the end."""
        return len(self.words) + len(self.log_total), len(self.class_mass) - 1

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
        """The texts' input symbols, each text with its end, and the texts' bounds."""
        w = Words(texts)
        own = self.coded(w.hashes.view(np.int64), _ending(w))[0].astype(self.kind)
        return np.insert(own, w.bounds[1:], self.end[0]), w.bounds + np.arange(len(w.bounds)), w

    def targets(self, symbols: np.ndarray) -> list[np.ndarray]:
        """Each token's input (the symbol before it; the end before the first), class and word, of whole texts' symbols."""
        after = symbols.astype(np.int32)
        before = np.concatenate(([self.end[0]], after[:-1])).astype(np.int32) if len(after) else after
        classes = np.concatenate((self.word_class, np.arange(self.heads, len(self.class_mass)))).astype(np.int32)
        return [before, classes[after], np.where(after < len(self.words), after, -1)]

    def tokens(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, Words]:
        """The targets of texts, and the texts' bounds."""
        symbols, bounds, w = self.symbols(texts)
        return self.targets(symbols), bounds, w

    def network(self, hidden: int, seed: int) -> Recurrent:
        return Recurrent(self.word_class, self.word_mass, self.class_mass, len(self.words) + len(self.log_total) + 1, hidden, seed)


def vocabulary(counts: DataFrame, texts: int, head: int = 2048, head_classes: int = 32, endings: int = 64) -> Vocabulary:
    """From all word counts (a stored table). At most `head` words and 65,536 sums by ending reach the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(head).select("word", "n", "ending").toArrow()
    words, mass, own = (top.column(c).to_numpy() for c in ("word", "n", "ending"))
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    tokens, distinct = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    tokens[sums.column("ending").to_numpy()], distinct[sums.column("ending").to_numpy()] = sums.column("n").to_numpy(), sums.column("words").to_numpy()
    total, every = int(tokens.sum()) + texts, int(distinct.sum()) + (texts > 0)
    np.subtract.at(tokens, own, mass)
    np.subtract.at(distinct, own, 1)
    root = np.cumsum(np.sqrt(mass))  # classes of equal sums of square roots
    word_class = np.minimum((head_classes * (root - np.sqrt(mass) / 2) / root[-1]).astype(np.int64), head_classes - 1) if len(mass) else np.zeros(0, np.int64)
    word_class = np.unique(word_class, return_inverse=True)[1].reshape(-1)
    heads = int(word_class.max()) + 1 if len(mass) else 0
    often = np.lexsort((np.arange(1 << 16), -tokens))[: endings - 1]
    often = often[tokens[often] > 0]
    ending_class = np.full(1 << 16, heads + len(often))
    ending_class[often] = heads + np.arange(len(often))
    by_class = np.bincount(ending_class - heads, tokens, len(often) + 1)
    smooth = by_class + PSEUDO * (np.bincount(ending_class - heads, distinct, len(often) + 1) + 1)
    class_mass = np.concatenate((np.bincount(word_class, mass, heads) if heads else np.zeros(0), by_class, [texts]))
    return Vocabulary(words, word_class, mass.astype(float), class_mass, ending_class, np.log10(smooth), total, every, texts)


def as_symbols(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, text) -> mark (a hash of both), symbols: whole texts as the network's input symbols."""

    def code(batches):
        for batch in pieces(batches, 1, 8 << 20):
            found, bounds, _ = vocab.symbols(encoded(batch.column(1)))
            ends = pa.py_buffer((bounds * found.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(found)])], names=["mark", "symbols"])

    return docs.select(F.xxhash64("doc_id", "text").alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(code, "mark long, symbols binary")


def fit(docs: DataFrame, vocab: Vocabulary, enough: int = 1_500_000, rounds: int = 3, rate: float = 0.01, hidden: int = 24, seed: int = 5, each: int = 4_000_000) -> Recurrent:
    """The network, by truncated backpropagation on several learners whose weights are averaged after each round.

    Every text is learnt from: the rounds go through all of them once, by hash, and a round takes further texts
    while it has fewer than `enough` tokens. There is a learner for every `each` tokens, so that a learner's
    work doesn't grow with the corpus; their weights are averaged in as many groups as the square root of
    their number before they reach the driver.
    """
    net = vocab.network(hidden, seed)
    if not vocab.texts:
        return net
    learners = math.ceil(vocab.total / each)
    places = 1 << 20
    width = max(math.ceil(places / rounds), round(places * min(1.0, enough / vocab.total)))
    coded = cut(as_symbols(docs, vocab).repartition(learners, "mark").sortWithinPartitions("mark"))
    dealt = coded.rdd.getNumPartitions()  # more than the learners asked for where the session raises it
    groups = math.ceil(math.sqrt(dealt))
    lanes = max(64, min(256, 64 * learners, int(vocab.total / dealt * width / places) // 5000))  # few tokens need more steps
    for turn in range(rounds):
        flat, own_rate = net.parameters(), rate / 2**turn

        def learn(batches, flat=flat, own_rate=own_rate):
            mine = vocab.network(hidden, seed).load(flat)
            adam, seen, loss = Adam(mine, own_rate), 0, 0.0
            for batch in pieces(batches, 0, 2 << 20):
                found = [np.frombuffer(b, vocab.kind) for b in batch.column(0).to_pylist()]
                bounds = np.cumsum([0, *map(len, found)])
                more, n = train(mine, adam, *vocab.targets(np.concatenate(found)), bounds, lanes=lanes)
                seen, loss = seen + n, loss + more
            if seen:
                own = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([own % groups]), pa.array([seen]), pa.array([mine.parameters().astype(np.float32).tobytes()])], names=["learner", "part", "tokens", "weights"])

        def mean(rows):
            rows = rows.sort_by("learner")
            tokens = rows.column("tokens").to_numpy()
            total = sum(np.frombuffer(w, np.float32) * (n / tokens.sum()) for w, n in zip(rows.column("weights").to_pylist(), tokens, strict=True))
            return pa.table({"part": rows.column("part")[:1], "tokens": [int(tokens.sum())], "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        begin = turn * places // rounds
        own = coded.filter((F.pmod("mark", F.lit(places)) + (places - begin)) % places < width)
        learnt = own.select("symbols").mapInArrow(learn, "learner long, part long, tokens long, weights binary")
        means = cut(learnt.groupBy("part").applyInArrow(mean, "part long, tokens long, weights binary")).orderBy("part").collect()
        if means:
            tokens = sum(r["tokens"] for r in means)
            net.load(sum(np.frombuffer(r["weights"], np.float32) * (r["tokens"] / tokens) for r in means))
    return net


def likelihoods(docs: DataFrame, vocab: Vocabulary, net: Recurrent, counts: DataFrame, most_words: int = 8_000_000) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score for each row; repeated rows are repeated.

    The network's part needs the frequent words only. What a word's count adds comes from `counts`, which
    go to every task up to `most_words` words and are joined beyond, frequent words spread over tasks.
    """
    spark = docs.sparkSession
    flat, hidden = net.parameters(), net.hidden
    known = counts.count() <= most_words
    table = None
    if known:
        got = counts.select("word", "n").toArrow()
        word = got.column("word").to_numpy()
        order = np.argsort(word)
        table = spark.sparkContext.broadcast((word[order], got.column("n").to_numpy()[order]))
    fixed = math.log10(vocab.texts + PSEUDO) - vocab.log_all

    def judge(batches):
        mine = vocab.network(hidden, 0).load(flat)
        for batch in pieces(batches, 1, 16 << 20):
            texts = encoded(batch.column(1))
            parts, sizes, sums, listed = [], [], [], []
            for lo, hi in chunks(texts, 8 << 20):
                tokens, bounds, w = vocab.tokens(texts[lo:hi])
                parts.append(tokens)
                sizes.append(np.diff(bounds))
                word, back = np.unique(w.hashes.view(np.int64), return_inverse=True)
                classes = np.zeros(len(word), np.int64)
                classes[back] = np.delete(tokens[1], bounds[1:] - 1)  # without the ends
                in_class = np.where(classes < vocab.heads, np.nan, 0.0)
                if len(word):
                    in_class = np.where(classes < vocab.heads, np.nan, vocab.log_total[np.maximum(classes - vocab.heads, 0)])
                owner = np.repeat(np.arange(hi - lo), np.diff(w.bounds))
                if table is not None:
                    keys, held = table.value
                    at = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                    n = np.where(keys[at] == word, held[at], 0) if len(keys) else np.zeros(len(word), np.int64)
                    base = np.log10(n + PSEUDO)
                    tail = np.where(np.isnan(in_class), 0, base - in_class)
                    sums.append([np.bincount(owner, v[back], hi - lo) for v in (n > 0, base - vocab.log_all, tail)])
                else:
                    pair, times = np.unique(owner * max(1, len(word)) + back, return_counts=True)
                    listed.append((np.bincount(pair // max(1, len(word)), minlength=hi - lo), word[pair % max(1, len(word))], times, in_class[pair % max(1, len(word))]))
            if not parts:
                continue
            size = np.concatenate(sizes)
            neural = score(mine, *(np.concatenate([p[i] for p in parts]) for i in range(3)), np.concatenate(([0], np.cumsum(size)))) / math.log(10)
            out = [batch.column(0), pa.array(size.astype(np.int64))]
            if table is not None:
                n_known, base, tail = (np.concatenate([s[i] for s in sums]) for i in range(3))
                out += [pa.array(n_known.astype(np.int64) + (vocab.texts > 0)), pa.array(base + fixed), pa.array(neural + tail)]
            else:
                ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate([x[0] for x in listed])))).astype(np.int32))
                out += [pa.array(neural), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in listed]))) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = docs.select("doc_id").schema.add("n_tokens", LongType())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if known:
        for c, kind in (("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType())):
            schema = schema.add(c, kind)
        names = schema.names
        return rows.mapInArrow(judge, schema)
    for c, kind in (("neural", DoubleType()), ("words", ArrayType(LongType())), ("times", ArrayType(LongType())), ("in_class", ArrayType(DoubleType()))):
        schema = schema.add(c, kind)
    names = schema.names
    judged = stored(rows.mapInArrow(judge, schema).withColumn("row", F.monotonically_increasing_id()))
    each = judged.select("row", F.explode(F.arrays_zip("words", "times", "in_class")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"), F.col("w.in_class").alias("in_class"))
    hot = counts.filter(F.col("n") * 1000 >= vocab.total).select("word", F.expr(f"cast(n * 1000 div {max(1, vocab.total)} + 1 as int)").alias("__parts"))
    met = spread_join(each, counts.select("word", "n"), ["word"], "left", hot=hot)
    base = F.log10(F.coalesce("n", F.lit(0)) + PSEUDO)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * (base - vocab.log_all)).alias("base"), F.sum(F.when(F.isnan("in_class"), 0.0).otherwise(F.col("times") * (base - F.col("in_class")))).alias("tail")
    )
    zero = F.lit(0)
    return judged.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.coalesce("n_known", zero) + int(vocab.texts > 0)).cast("long").alias("n_known"), (F.coalesce("base", zero.cast("double")) + fixed).alias("base_score"), (F.col("neural") + F.coalesce("tail", zero.cast("double"))).alias("score")
    )


def lm_scores(docs: DataFrame, most_words: int = 8_000_000, **options) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Tokens are the words of the text, A-Z lower-cased, and one end. Rows whose crc32(doc_id as text) is
    divisible by 10, and those without an id, are held out: nothing is learnt from them. Null texts are
    empty and have the end only. Repeated rows count, and are scored, as often as they occur. Other
    columns are ignored; an empty table gives no rows; with nothing to learn from, all words are unknown.

    base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, with counts over all of the
    training texts. score is the log10 probability of the whole text by the recurrent network: of
    each token's class and, for the most frequent words, of the word in its class; another word's share
    of its class comes from the counts, smoothed likewise, with one outcome for unseen words. Words
    are told apart by 64-bit hashes.
    """
    learnt = docs.filter(~tenth())
    counts = stored(word_counts(learnt))
    vocab = vocabulary(counts, learnt.count())
    net = fit(learnt, vocab, **options)
    out = likelihoods(docs, vocab, net, counts, most_words)
    return out.select("doc_id", tenth().alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
