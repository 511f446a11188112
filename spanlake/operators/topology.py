"""Service topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_service(spans: DataFrame) -> DataFrame:
    """`service` from service_name, then service, then `unknown`."""
    names = [F.col(c) for c in ("service_name", "service") if c in spans.columns]
    return spans.withColumn("service", F.coalesce(*names, F.lit("unknown")))


def service_edges(spans: DataFrame) -> DataFrame:
    """A row for each span whose parent is of another service: source, target, duration_ms, error."""
    s = with_service(spans)
    child = s.filter("parent_span_id is not null").select(F.col("parent_span_id").alias("pid"), F.col("service").alias("target"), "duration_ms", "error")
    parent = s.select(F.col("span_id").alias("pid"), F.col("service").alias("source"))
    return child.join(parent, "pid").filter("source <> target").select("source", "target", "duration_ms", "error")


def service_nodes(spans: DataFrame) -> DataFrame:
    """Service, span_count, error_count, avg_ms, endpoints (distinct, sorted).

    Distinct endpoints are found before they are gathered, so a service's list is as long as its names.
    """
    s = with_service(spans)
    stats = s.groupBy("service").agg(F.count("*").alias("span_count"), F.count("error").alias("error_count"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))
    names = s.select("service", "name").distinct().groupBy("service").agg(F.sort_array(F.collect_list("name")).alias("endpoints"))
    return stats.join(names, "service", "left")


def service_topology(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges with call_count, error_count and the children's avg_ms."""
    edges = service_edges(spans).groupBy("source", "target").agg(F.count("*").alias("call_count"), F.count("error").alias("error_count"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))
    return service_nodes(spans), edges


def topology_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Services, dependencies, total_spans."""
    return nodes.agg(F.count("*").alias("services"), F.sum("span_count").alias("total_spans")).crossJoin(edges.agg(F.count("*").alias("dependencies")))
