"""Execution forests: nodes, edges, closure, chains, paths and cycles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: below spark.checkpoint.dir; only a local session needs none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spanlake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a table in the shared folder, which outlives executors."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Cuts lineage like `cut`, with tables that are deleted at the end of the with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "scratch")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def build_span_nodes(events: DataFrame) -> DataFrame:
    """One node for each span_id.

    The base is the first ENTRY, else EXIT, else ERROR, else any event; start comes from the first
    ENTRY, end and duration from the last EXIT, the error from the last ERROR. A span with an ENTRY
    and an ERROR but no EXIT has no duration and no end.
    """
    kind = F.col("event_type")
    rank = F.when(kind == "ENTRY", 0).when(kind == "EXIT", 1).when(kind == "ERROR", 2).otherwise(3)
    base = ("function_name", "module", "source_file", "source_line", "context_id", "parent_span_id", "depth", "thread_id", "thread_name")
    by = lambda k, c, f=F.max_by: f(F.struct(c), F.when(kind == k, F.struct("timestamp"))).getField(c)
    out = events.groupBy("span_id").agg(
        F.min_by(F.struct(*base), F.struct(rank, "timestamp")).alias("base"),
        F.min(F.when(kind == "ENTRY", F.col("timestamp"))).alias("start_time"),
        F.max(F.when(kind == "EXIT", F.col("timestamp"))).alias("end_time"),
        by("EXIT", "duration").alias("duration"),
        by("ERROR", "error").alias("error"),
    )
    return out.select("span_id", "base.*", "start_time", "end_time", "duration", "error", F.col("base.context_id").isNotNull().alias("has_context"))


def link_parents(nodes: DataFrame) -> DataFrame:
    """parent_id, child_id, edge_type (`cross_thread` where thread ids differ, else `call`)."""
    child = nodes.filter("parent_span_id is not null").select(F.col("parent_span_id").alias("parent_id"), F.col("span_id").alias("child_id"), F.col("thread_id").alias("ct"))
    parent = nodes.select(F.col("span_id").alias("parent_id"), F.col("thread_id").alias("pt"))
    crossed = ~F.col("ct").eqNullSafe(F.col("pt"))
    return child.join(parent, "parent_id").select("parent_id", "child_id", F.when(crossed, "cross_thread").otherwise("call").alias("edge_type"))


def orphan_or_root(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent, or whose parent is absent."""
    return nodes.join(nodes.select(F.col("span_id").alias("parent_span_id")), "parent_span_id", "left_anti").select(*nodes.columns)


def find_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """No edge leads to them."""
    return nodes.join(edges, nodes["span_id"] == edges["child_id"], "left_anti")


def find_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """No edge leads from them."""
    return nodes.join(edges, nodes["span_id"] == edges["parent_id"], "left_anti")


def find_context_gaps(nodes: DataFrame) -> DataFrame:
    """G04."""
    return nodes.filter("context_id is null")


def find_cross_thread_edges(edges: DataFrame) -> DataFrame:
    """G05."""
    return edges.filter("edge_type = 'cross_thread'")


def find_errors(nodes: DataFrame) -> DataFrame:
    """G06."""
    return nodes.filter("error is not null and error <> ''")


def ancestor_closure(nodes: DataFrame, seeds: DataFrame | None = None, max_rounds: int = 30) -> DataFrame:
    """span_id, ancestor_id, distance; every node is its own ancestor at 0.

    By pointer doubling: each round joins the known paths with the jumps of length 2^k and doubles the
    jumps, so the rounds are log2 of the depth. With `seeds` (span_id) only the seeds' paths are made.
    A path ends where it would reach its own start again.
    """
    up = nodes.filter("parent_span_id is not null").select("span_id", F.col("parent_span_id").alias("ancestor_id"))
    up = up.join(nodes.select(F.col("span_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi").filter("span_id <> ancestor_id").select("span_id", "ancestor_id")
    start = nodes.select("span_id").distinct()
    start = start if seeds is None else start.join(seeds.select("span_id"), "span_id", "left_semi")
    out = cut(start.select("span_id", F.col("span_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance")))
    jumps = cut(up)
    for k in range(max_rounds):
        if jumps.isEmpty():
            return out
        far = out.toDF("span_id", "at", "d").join(jumps.toDF("at", "ancestor_id"), "at").filter("span_id <> ancestor_id")
        out = out.union(cut(far.select("span_id", "ancestor_id", (F.col("d") + (1 << k)).alias("distance"))))
        jumps = cut(jumps.toDF("span_id", "at").join(jumps.toDF("at", "ancestor_id"), "at").filter("span_id <> ancestor_id").select("span_id", "ancestor_id"))
        if k > 12 and out.groupBy("span_id", "ancestor_id").count().filter("count > 1").limit(1).count():
            break  # only a cycle reaches an ancestor twice
    return out.groupBy("span_id", "ancestor_id").agg(F.min("distance").alias("distance"))


def causal_chain(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """span_id, chain: the functions from the root down to the span."""
    names = nodes.select(F.col("span_id").alias("ancestor_id"), F.coalesce("function_name", F.lit("")).alias("function_name"), "error")
    rows = closure.join(names, "ancestor_id").groupBy("span_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor_id", "function_name", "error"))).alias("c"))
    return rows.select("span_id", F.col("c.function_name").alias("chain"), F.col("c.ancestor_id").alias("chain_ids"))


def context_subgraph(nodes: DataFrame, edges: DataFrame, context_id: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of one context, and the edges with both ends among them."""
    inside = nodes.filter(F.col("context_id") == context_id)
    ids = inside.select("span_id")
    kept = edges.join(ids.withColumnRenamed("span_id", "parent_id"), "parent_id", "left_semi").join(ids.withColumnRenamed("span_id", "child_id"), "child_id", "left_semi")
    return inside, kept.select(*edges.columns)


def branching_points(edges: DataFrame) -> DataFrame:
    """span_id, degree of nodes with more than one child."""
    return edges.groupBy(F.col("parent_id").alias("span_id")).agg(F.count("*").alias("degree")).filter("degree > 1")


def convergence_points(edges: DataFrame) -> DataFrame:
    """span_id, degree of nodes with more than one parent (span links give an edge table such rows)."""
    return edges.groupBy(F.col("child_id").alias("span_id")).agg(F.count("*").alias("degree")).filter("degree > 1")


def critical_path(nodes: DataFrame, closure: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """For each root the root-to-leaf path of the largest summed duration (null counts 0).

    root_id, leaf_id, total, path (function names), path_ids; ties go to the smaller leaf id. Sums are
    made by pointer doubling, one row for each node; only the best leaves' paths are spelled out, from
    `closure` where it is at hand. Nodes below a cycle have no root and no path.
    """
    known = nodes.select(F.col("span_id").alias("at")).distinct().withColumn("there", F.lit(True))
    own = nodes.select("span_id", F.when(F.col("parent_span_id") != F.col("span_id"), F.col("parent_span_id")).alias("at"), F.coalesce("duration", F.lit(0.0)).alias("total")).join(known, "at", "left")
    sums = cut(own.select("span_id", F.when(F.col("there"), F.col("at")).alias("at"), "total", F.when(F.col("there").isNull(), F.col("span_id")).alias("root_id")))
    for _ in range(max_rounds):
        if sums.filter("at is not null").isEmpty():
            break
        above = sums.select(F.col("span_id").alias("at"), F.col("at").alias("next"), F.col("total").alias("more"), F.col("root_id").alias("top"))
        sums = cut(sums.join(above, "at", "left").select("span_id", F.col("next").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), F.coalesce("root_id", "top").alias("root_id")))
    parents = nodes.filter("parent_span_id is not null").select(F.col("parent_span_id").alias("span_id")).distinct()
    leaves = sums.filter("at is null").select("span_id", F.round("total", 6).alias("total"), "root_id").join(parents, "span_id", "left_anti")
    first = Window.partitionBy("root_id").orderBy(F.desc("total"), "span_id")
    best = cut(leaves.withColumn("no", F.row_number().over(first)).filter("no = 1").drop("no"))
    closure = ancestor_closure(nodes, best.select("span_id")) if closure is None else closure.join(best.select("span_id"), "span_id", "left_semi")
    return best.join(causal_chain(nodes, closure), "span_id").select("root_id", F.col("span_id").alias("leaf_id"), "total", F.col("chain").alias("path"), F.col("chain_ids").alias("path_ids"))


def render_depth(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """span_id, depth, sort_path: rows in order of sort_path are the trees in pre-order."""
    part = F.concat(F.lpad(F.coalesce("start_time", F.lit(0.0)).cast("decimal(18,3)").cast("string"), 20, "0"), F.lit("|"), F.col("span_id"))
    keys = nodes.select(F.col("span_id").alias("ancestor_id"), part.alias("part"))
    rows = closure.join(keys, "ancestor_id").groupBy("span_id").agg(F.max("distance").alias("depth"), F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("o"), "part"))).alias("p"))
    return rows.select("span_id", "depth", F.array_join("p.part", "/").alias("sort_path"))


def cascading_failures(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """root_id, affected_id: pairs of failed spans of which the first is an ancestor of the second."""
    bad = find_errors(nodes).select("span_id").distinct()
    pairs = closure.filter("distance > 0").join(bad, "span_id", "left_semi").join(bad.withColumnRenamed("span_id", "ancestor_id"), "ancestor_id", "left_semi")
    return pairs.select(F.col("ancestor_id").alias("root_id"), F.col("span_id").alias("affected_id"), "distance")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    n = nodes.agg(
        F.count("*").alias("spans"),
        F.count_distinct("context_id").alias("contexts"),
        F.count_if(F.col("context_id").isNull()).alias("gaps"),
        F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"),
    )
    e = edges.agg(F.count_if(F.col("edge_type") == "cross_thread").alias("cross_thread_edges"), F.count_distinct("child_id").alias("with_parent"))
    b = branching_points(edges).agg(F.count("*").alias("branching_points"))
    out = n.crossJoin(e).crossJoin(b)
    return out.select("spans", "contexts", (F.col("spans") - F.col("with_parent")).alias("roots"), "branching_points", "cross_thread_edges", "gaps", "errors")


def find_cycles(edges: DataFrame, max_len: int = 6) -> DataFrame:
    """`members` (sorted) and `length` of the cycles of at most max_len edges in (a, b) edges.

    A cycle is expanded from its smallest member only, so each simple cycle is walked once; those of
    one member set are one row. Nodes that no cycle can hold (no way in or out) go first.
    """
    live = edges.select("a", "b").distinct().filter("a <> b")
    for _ in range(2):
        live = live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    live = cut(live.select("a", "b"))
    closed = F.element_at("path", 1) == F.element_at("path", -1)
    found = None
    front = cut(live.filter("a < b").select(F.array("a", "b").alias("path")))
    for _ in range(max_len - 1):
        front = front.withColumn("at", F.element_at("path", -1)).join(live.toDF("at", "to"), "at")
        front = front.filter((F.col("to") >= F.col("path")[0]) & ~F.array_contains(F.slice("path", 2, F.size("path")), F.col("to")))
        front = cut(front.select(F.concat("path", F.array("to")).alias("path")))
        ring = front.filter(closed).select(F.sort_array(F.array_distinct("path")).alias("members"))
        found = ring if found is None else found.union(ring)
        front = front.filter(~closed)
    return found.distinct().withColumn("length", F.size("members"))


def is_dag(edges: DataFrame) -> bool:
    """Whether (a, b) edges hold no cycle: leaves are taken away until none is left."""
    live = cut(edges.select("a", "b").distinct())
    while True:
        n = live.count()
        if not n:
            return True
        live = cut(live.join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if live.count() == n:
            return False
