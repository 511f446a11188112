"""Mixing sources to target weights by hierarchical token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut

LEVELS = ("domain", "lang", "source")
#: level -> {value: weight}; a value that isn't listed has weight 1.
WEIGHTS = {"domain": {"long": 3, "short": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}, "source": {"src0": 2}}


def word_count(text: Column) -> Column:
    """Words between ASCII spaces, 0 for null: the unit of the budgets."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def prefix_of(text: Column, words: Column) -> Column:
    """The text up to the end of its word number `words`, with the spaces before and between as they are."""
    pieces = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def domain(text: Column) -> Column:
    """The tree's first level: texts of 4,000 code points or more against all others."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) >= 4000, "long").otherwise("short")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("double")


def _filled(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Share each parent's budget among its nodes by weight, none above its capacity.

    Water-filling: in order of capacity / weight, a node is full if the level that the remaining
    budget and weight give at it would exceed its capacity; the others split what the full ones
    leave, by weight. Shares are rounded down; the tokens so left over go one each to the heaviest of
    these nodes, ties by name.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *LEVELS)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    zero = F.lit(0)
    nodes = nodes.withColumns({"used": F.coalesce(F.sum("capacity").over(before), zero), "gone": F.coalesce(F.sum("weight").over(before), zero), "all": F.sum("weight").over(whole)})
    full = (F.col(budget) - F.col("used")) * F.col("weight") >= F.col("capacity") * (F.col("all") - F.col("gone"))
    nodes = nodes.withColumn("full", full)
    held, heavy = (F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(whole) for c in ("capacity", "weight"))
    nodes = nodes.withColumns({"held": held, "heavy": heavy})
    share = F.floor((F.col(budget) - F.col("held")) * F.col("weight") / (F.col("all") - F.col("heavy")))
    nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.least(share, F.col("capacity")), zero)).cast("long"))
    room = ~F.col("full") & (F.col("budget") < F.col("capacity"))
    turn = F.row_number().over(Window.partitionBy(*parent).orderBy(room.desc(), F.desc("weight"), *LEVELS))
    nodes = nodes.withColumns({"left": F.col(budget) - F.sum("budget").over(whole), "turn": turn})
    nodes = nodes.withColumn("budget", F.col("budget") + F.when(room & (F.col("turn") <= F.col("left")), 1).otherwise(0))
    return nodes.drop("used", "gone", "all", "full", "held", "heavy", "left", "turn")


def leaf_budgets(leaves: DataFrame, weights: dict, total_tokens: int | None, share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens) -> the same with each leaf's budget.

    A subtree's capacity is max_epochs times its tokens. Budgets go down level by level, so what a
    node can't use goes to its siblings; only what a whole subtree can't use reaches its uncles.
    """
    level = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    wanted = F.floor(F.sum("tokens") * share) if total_tokens is None else F.lit(total_tokens)
    down = level.groupBy().agg(F.least(wanted.cast("long"), F.sum("capacity")).alias("given"))
    parent: list[str] = []
    for i, name in enumerate(LEVELS):
        mine = [*LEVELS[: i + 1]]
        nodes = level.groupBy(*mine).agg(F.sum("capacity").alias("capacity")).filter("capacity > 0")
        nodes = nodes.join(down, parent) if parent else nodes.crossJoin(F.broadcast(down))
        nodes = nodes.withColumn("weight", _weight(name, weights))
        for missing in LEVELS[i + 1 :]:
            nodes = nodes.withColumn(missing, F.lit(""))
        down = _filled(nodes, parent or [F.lit(0)], "given").select(*mine, F.col("budget").alias("given"))
        parent = mine
    return leaves.join(down.withColumnRenamed("given", "budget"), [*LEVELS])


def mix(docs: DataFrame, weights: dict | None = None, total_tokens: int | None = None, share: float = 0.5, max_epochs: int = 2, seed: str = "mix", with_text: bool = False, most_leaves: int = 100_000) -> DataFrame:
    """(doc_id, text, lang, source) -> the selected documents: doc_id, domain, lang, source, epoch, tokens, taken.

    The budget is `total_tokens`, or `share` of all tokens. A leaf's budget takes whole epochs of
    its documents first, then a prefix of the next epoch, whose order is the md5 of seed, epoch and
    doc_id (ties by doc_id); the document at the border gives its first `taken` tokens. Rows are
    (document, epoch). with_text adds the text, cut after the word `taken`. Null lang is `und`, null
    source `unknown`; texts without words are never taken. Repeated rows are separate documents that
    follow each other; rows with a null id hash alike and come first among equals. Other columns are
    ignored; an empty table gives no rows.

    Sums by leaf and hash bucket come first. They give each leaf the bucket in which its last epoch ends:
    rows of earlier buckets are taken as they stand, later ones are left, and only those of that bucket,
    one in 4,096, are moved and ordered. Up to `most_leaves` leaves' plans go to every task, more are joined.
    """
    weights = WEIGHTS if weights is None else weights
    text = ["text"] if with_text else []
    d = docs.select("doc_id", domain(F.col("text")).alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), word_count(F.col("text")).alias("tokens"), *text).filter("tokens > 0")
    narrow = cut(d.drop("text"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, total_tokens, share, max_epochs)
    plan = cut(budgets.select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")).filter("whole > 0 or rest > 0"))
    small = plan.count() <= most_leaves
    sent = lambda df: F.broadcast(df) if small else df
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))

    bins = narrow.join(sent(plan.filter("rest > 0")), [*LEVELS]).groupBy(*LEVELS, "rest", F.substring(place, 1, 3).alias("edge")).agg(F.sum("tokens").alias("s"))
    until = Window.partitionBy(*LEVELS).orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    edges = bins.withColumn("base", F.sum("s").over(until) - F.col("s")).filter("base < rest and rest <= base + s").select(*LEVELS, "edge", "base")
    plan = sent(cut(plan.join(edges, [*LEVELS], "left")))

    d = (d if with_text else narrow).join(plan, [*LEVELS]).withColumn("place", place).withColumn("bin", F.substring("place", 1, 3))
    out = lambda df, epoch, taken: df.select("doc_id", *LEVELS, epoch.alias("epoch"), "tokens", taken.alias("taken"), *text)
    passes = F.col("whole") + F.when(F.col("bin") < F.col("edge"), 1).otherwise(0)
    full = out(d.filter(passes > 0), F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)), F.col("tokens"))
    inside = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "tokens", *text).rowsBetween(Window.unboundedPreceding, -1)
    last = d.filter("bin = edge").withColumn("ahead", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).filter("ahead < rest")
    prefix = out(last, F.col("whole"), F.least("tokens", F.col("rest") - F.col("ahead")))
    if with_text:
        prefix = prefix.withColumn("text", F.when(F.col("taken") < F.col("tokens"), prefix_of(F.col("text"), F.col("taken"))).otherwise(F.col("text")))
    return full.unionByName(prefix)
