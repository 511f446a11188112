"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, spread_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (id, component): the smallest id that each linked id reaches.

    Ids that occur in no pair of different ids are absent. Each round moves links to the smallest
    neighbour, so the number of pairs never grows and a chain of n ids needs about log n rounds;
    every round is checkpointed and only its size and checksum reach the driver.
    """
    pairs = cut(_tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    mark = _mark(pairs)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        pairs = pairs.coalesce(mark[0] // 50_000 + 1)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = spread_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = cut(_tidy(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")))
        before, mark = mark, _mark(pairs)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    found = pairs.groupBy("u").agg(F.min("v").alias("v"))
    roots = found.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u > v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
