"""Pre-order intervals of span forests by list ranking, and ancestor pairs as an equi-join on dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.graph import Scratch, cut, find_errors


def tree_intervals(nodes: DataFrame) -> DataFrame:
    """span_id, root_id, pre (place in the tree's pre-order, from 0), last (that of the last descendant), depth.

    x is an ancestor of y if both have the same root and x.pre < y.pre <= x.last. Siblings are in the order of
    start_time (null first) and span_id. Every span enters and leaves the tour around its tree; the
    steps to the tour's end are counted by pointer doubling, so rows stay two for each span and rounds are the
    logarithm of the largest tree, whatever its depth. A span whose parent is absent, or is itself,
    is a root; spans on or below a cycle of parents have no root and no row.
    """
    with Scratch(nodes.sparkSession) as keep:
        first = nodes.groupBy("span_id").agg(F.min(F.struct("start_time", "parent_span_id")).alias("s")).select("span_id", "s.*")
        known = first.select(F.col("span_id").alias("parent"), F.lit(True).alias("there"))
        tree = first.withColumn("parent", F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id"))).join(known, "parent", "left")
        tree = tree.select("span_id", F.when(F.col("there"), F.col("parent")).alias("parent"), "start_time")
        order = Window.partitionBy("parent").orderBy(F.col("start_time").asc_nulls_first(), "span_id")
        # roots are no siblings: they don't meet in one partition
        below = tree.filter("parent is not null").withColumns({"next": F.lead("span_id").over(order), "no": F.row_number().over(order)})
        tree = keep(below.unionByName(tree.filter("parent is null").withColumns({"next": F.lit(None).cast("string"), "no": F.lit(0)})))
        eldest = tree.filter("no = 1").select(F.col("parent").alias("span_id"), F.col("span_id").alias("child"))
        enter = lambda c: F.concat(F.lit("<"), c)
        leave = lambda c: F.concat(F.lit(">"), c)
        rows = tree.join(eldest, "span_id", "left")
        entries = rows.select(enter("span_id").alias("at"), F.coalesce(enter("child"), leave("span_id")).alias("to"), F.lit(1).alias("enters"), F.lit(1).alias("levels"), F.lit(None).cast("string").alias("root"))
        exits = rows.select(leave("span_id").alias("at"), F.coalesce(enter("next"), leave("parent")).alias("to"), F.lit(0).alias("enters"), F.lit(-1).alias("levels"), F.when(F.col("parent").isNull(), F.col("span_id")).alias("root"))
        tour = entries.unionByName(exits).withColumns({"enters": F.col("enters").cast("long"), "levels": F.col("levels").cast("long")})
        open_before = -1
        while True:
            tour = keep(tour)
            left = tour.filter("to is not null").count()
            if left in (0, open_before):  # a list's open steps get fewer each round; what doesn't is a circle
                break
            open_before = left
            ahead = tour.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("enters").alias("e"), F.col("levels").alias("l"), F.col("root").alias("r"))
            zero = F.lit(0)
            tour = tour.join(ahead, "to", "left").select("at", F.col("further").alias("to"), (F.col("enters") + F.coalesce("e", zero)).alias("enters"), (F.col("levels") + F.coalesce("l", zero)).alias("levels"), F.coalesce("root", "r").alias("root"))
        done = tour.filter("to is null").select(F.substring("at", 2, 1 << 30).alias("span_id"), F.substring("at", 1, 1).alias("side"), "enters", "levels", "root")
        ends = done.filter("side = '>'").select("span_id", F.col("enters").alias("after"))
        starts = done.filter("side = '<'").join(ends, "span_id")
        sizes = starts.filter("span_id = root").select("root", F.col("enters").alias("n"))
        pre, last = F.col("n") - F.col("enters"), F.col("n") - F.col("after") - 1
        return cut(starts.join(sizes, "root").select("span_id", F.col("root").alias("root_id"), pre.alias("pre"), last.alias("last"), (-F.col("levels")).alias("depth")))


def _blocks(low: str, high: str) -> Column:
    """The dyadic blocks (level, block) that make up the whole numbers from `low` to `high`: two for each level at most."""
    step = """
      (s, j) -> named_struct(
        'low', if(s.low <= s.high, (s.low + s.low % 2) div 2, 1L), 'high', if(s.low <= s.high, (s.high + 1 - (s.high + 1) % 2) div 2 - 1, 0L),
        'found', concat(s.found,
          if(s.low <= s.high and s.low % 2 = 1, array(named_struct('level', j, 'block', s.low)), array()),
          if(s.low <= s.high and s.high % 2 = 0, array(named_struct('level', j, 'block', s.high)), array())))"""
    begin = f"named_struct('low', {low}, 'high', {high}, 'found', cast(array() as array<struct<level: int, block: bigint>>))"
    return F.expr(f"aggregate(sequence(0, 62), {begin}, {step}).found")


def ancestor_pairs(above: DataFrame, below: DataFrame) -> DataFrame:
    """ancestor_id, span_id, distance for rows of `tree_intervals`: each pair of which the first is an ancestor of the second.

    An ancestor's interval is cut into dyadic blocks, a descendant lies in one block of each level: so pairs meet
    by equality, each once, and rows that are no pair never meet.
    """
    levels = below.agg(F.coalesce(F.max("pre"), F.lit(0)).alias("m")).select(F.ceil(F.log2(F.col("m") + 2)).cast("int").alias("levels"))
    tops = above.select("root_id", F.col("span_id").alias("ancestor_id"), F.col("depth").alias("from_depth"), F.explode(_blocks("pre + 1", "last")).alias("b")).select("root_id", "ancestor_id", "from_depth", "b.level", "b.block")
    places = below.crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels"))))
    places = places.select("root_id", "span_id", "depth", "level", F.expr("shiftright(pre, level)").alias("block"))
    return tops.join(places, ["root_id", "level", "block"]).select("ancestor_id", "span_id", (F.col("depth") - F.col("from_depth")).alias("distance"))


def cascading_failures(nodes: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """root_id, affected_id, distance: pairs of failed spans of which the first is an ancestor of the second; no closure is made."""
    intervals = tree_intervals(nodes) if intervals is None else intervals
    bad = cut(intervals.join(find_errors(nodes).select("span_id").distinct(), "span_id", "left_semi"))
    return ancestor_pairs(bad, bad).select(F.col("ancestor_id").alias("root_id"), F.col("span_id").alias("affected_id"), "distance")
