"""Statistics over spans and nodes, outliers, self time, top-k and ordered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, share: float, out: str, margin: float = 0.004) -> DataFrame:
    """The value at 1-based `rank` (an expression over `n`, the key's row count) of each key, exactly.

    A first pass brackets the rank between two approximate percentiles around `share`, whose error
    is a ten-thousandth of the rows; a second counts what lies below and ranks only the bracket. So
    a key with a third of all rows sorts under one hundredth of them in a task. Nulls don't count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    low, high = max(share - margin, 0.0), min(share + margin, 1.0)
    p = F.percentile_approx(value, [low, high], 10_000)
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), p.alias("p"))
    # small groups are ranked whole, which also covers ranks that the margin would miss
    small = F.col("n") <= 2000
    stats = stats.select(*keys, "n", F.when(small, F.col("lo")).otherwise(F.col("p")[0]).alias("lo"), F.when(small, F.col("hi")).otherwise(F.col("p")[1]).alias("hi"), rank.cast("long").alias("want"))
    one = stats.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [rows[k].eqNullSafe(one[f"__{k}"]) for k in keys]
    both = rows.join(one, same) if keys else rows.crossJoin(F.broadcast(one))
    below = both.groupBy(*keys).agg(F.count_if(F.col(value) < F.col("lo")).alias("below"), F.first("want").alias("want"))
    values = both.filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))).groupBy(*keys, value).agg(F.count("*").alias("c"))
    running = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value)
    values = values.withColumn("upto", F.sum("c").over(running))
    two = below.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [values[k].eqNullSafe(two[f"__{k}"]) for k in keys]
    hit = values.join(two, same) if keys else values.crossJoin(F.broadcast(two))
    hit = hit.filter((F.col("upto") + F.col("below") >= F.col("want")) & (F.col("upto") + F.col("below") - F.col("c") < F.col("want")))
    return hit.select(*keys, F.col(value).alias(out))


def index_p95(df: DataFrame, keys: list[str], value: str, out: str = "p95_ms") -> DataFrame:
    """The value at 0-based index n * 95 // 100 of each key's sorted values (the last one at most)."""
    return value_at_rank(df, keys, value, F.least(F.expr("n * 95 div 100") + 1, F.col("n")), 0.95, out)


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The value at 0-based index n // 2."""
    return value_at_rank(df, keys, value, F.expr("n div 2") + 1, 0.5, out)


def _join_back(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(small, keys, "left") if keys else df.crossJoin(F.broadcast(small))


def span_stats(spans: DataFrame) -> DataFrame:
    """Name, count, avg_ms, max_ms, error_rate."""
    return spans.groupBy("name").agg(
        F.count("*").alias("count"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.round(F.avg(F.col("error").isNotNull().cast("double")), 6).alias("error_rate")
    )


def latency_summary(spans: DataFrame, keys: list[str] | None = None, exclude_zero: bool = False, approximate: bool = False) -> DataFrame:
    """total_spans, total_traces, error_count, avg_ms, p95_ms, max_ms for each key.

    The p95 is the exact index-p95 unless `approximate`, which is one pass with percentile_approx.
    exclude_zero leaves null and zero durations out of the latencies, not out of the counts.
    """
    keys = keys or []
    d = F.when(F.col("duration_ms") != 0, F.col("duration_ms")) if exclude_zero else F.col("duration_ms")
    rows = spans.withColumn("__d", d)
    aggs = [F.count("*").alias("total_spans"), F.count_distinct("trace_id").alias("total_traces"), F.count("error").alias("error_count"), F.round(F.avg("__d"), 4).alias("avg_ms"), F.max("__d").alias("max_ms")]
    if approximate:
        return rows.groupBy(*keys).agg(*aggs, F.percentile_approx("__d", 0.95, 10_000).alias("p95_ms"))
    return _join_back(rows.groupBy(*keys).agg(*aggs), index_p95(rows, keys, "__d"), keys)


def telemetry_overview(spans: DataFrame) -> DataFrame:
    """One row over all spans; latencies leave zero durations out, `unknown` is no service."""
    d = F.when(F.col("duration_ms") != 0, F.col("duration_ms"))
    rows = spans.withColumn("__d", d)
    one = rows.agg(
        F.count("*").alias("spans"),
        F.count_distinct("trace_id").alias("traces"),
        F.count_distinct("name").alias("operations"),
        F.count_distinct(F.when(F.col("service") != "unknown", F.col("service"))).alias("services"),
        F.round(F.avg("__d"), 4).alias("avg_ms"),
        F.count("error").alias("errors"),
        F.max("__d").alias("max_ms"),
        F.round(F.sum("__d"), 2).alias("total_ms"),
    )
    return one.crossJoin(index_p95(rows, [], "__d"))


def operation_outcomes(spans: DataFrame) -> DataFrame:
    """Name, outcome (`failed` if any span failed), last_error in order of start and id."""
    order = F.when(F.col("error").isNotNull(), F.struct("start_time_ms", "span_id"))
    out = spans.groupBy("name").agg(F.count("error").alias("failures"), F.max_by("error", order).alias("last_error"))
    return out.select("name", F.when(F.col("failures") > 0, "failed").otherwise("success").alias("outcome"), "last_error")


def error_histogram(spans: DataFrame) -> DataFrame:
    """Error, count, label `error (xN)`, most frequent first."""
    out = spans.filter("error is not null").groupBy("error").agg(F.count("*").alias("count"))
    return out.withColumn("label", F.concat("error", F.lit(" (x"), F.col("count").cast("string"), F.lit(")"))).orderBy(F.desc("count"), "error")


def trace_summary(spans: DataFrame) -> DataFrame:
    """trace_id, spans, status, duration_ms (of the longest root: no parent, or an absent one)."""
    ids = spans.select(F.col("span_id").alias("parent_span_id")).distinct()
    roots = spans.join(ids, "parent_span_id", "left_anti").groupBy("trace_id").agg(F.max("duration_ms").alias("duration_ms"))
    out = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.when(F.count("error") > 0, "ERROR").otherwise("OK").alias("status"))
    return out.join(roots, "trace_id", "left")


def bimodal_operations(nodes: DataFrame) -> DataFrame:
    """Functions of 4 or more timed nodes whose largest duration is over 5 upper medians."""
    timed = nodes.filter("duration is not null and duration <> 0").select("function_name", "duration")
    medians = upper_median(timed, ["function_name"], "duration")
    both = timed.join(medians, "function_name")
    out = both.groupBy("function_name").agg(
        F.count("*").alias("n"), F.first("median").alias("median"), F.max("duration").alias("largest"), F.count_if(F.col("duration") <= 2 * F.col("median")).alias("fast")
    )
    out = out.filter((F.col("n") >= 4) & (F.col("median") > 0) & (F.col("largest") / F.col("median") > 5))
    out = out.withColumn("slow", F.col("n") - F.col("fast")).filter("slow >= 1")
    return out.select("function_name", F.round(F.col("median") * 1000, 4).alias("median_ms"), F.round(F.col("largest") * 1000, 4).alias("max_ms"), "fast", "slow")


def statistical_outliers(nodes: DataFrame, slow_ms: float = 100.0) -> DataFrame:
    """Nodes over mean + 2 population deviations of their function (3 nodes or more, deviation
    over 5 ms); in smaller groups, nodes over slow_ms. Longest first.

    Group statistics are partially aggregated and joined back, so a frequent name isn't sorted in one task.
    """
    timed = nodes.filter("duration is not null and duration <> 0").withColumn("duration_ms", F.col("duration") * 1000)
    stats = timed.groupBy("function_name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.stddev_pop("duration_ms").alias("sigma"))
    both = timed.join(stats, "function_name")
    flagged = F.when(F.col("n") >= 3, (F.col("sigma") > 5) & (F.col("duration_ms") > F.col("mean") + 2 * F.col("sigma"))).otherwise(F.col("duration_ms") > slow_ms)
    return both.filter(flagged).select("span_id", "function_name", F.round("duration_ms", 4).alias("duration_ms"), "n").orderBy(F.desc("duration_ms"), "span_id")


def self_time(nodes: DataFrame, slow_ms: float = 100.0, top: int | None = 5) -> DataFrame:
    """Nodes of slow_ms or more that spend over 60 % and over 50 ms outside their children; the top ones."""
    ms = F.col("duration") * 1000
    slow = nodes.filter("duration is not null and duration <> 0").filter(ms >= slow_ms).select("span_id", "function_name", ms.alias("total_ms"))
    children = nodes.filter("parent_span_id is not null and duration is not null").groupBy(F.col("parent_span_id").alias("span_id")).agg(F.sum(ms).alias("child_ms"))
    both = slow.join(children, "span_id", "left").withColumn("child_ms", F.coalesce("child_ms", F.lit(0.0)))
    both = both.withColumn("self_ms", F.col("total_ms") - F.col("child_ms"))
    out = both.filter((F.col("self_ms") / F.col("total_ms") > 0.6) & (F.col("self_ms") > 50))
    out = out.select("span_id", "function_name", *(F.round(c, 4).alias(c) for c in ("total_ms", "self_ms", "child_ms")), F.round(F.col("self_ms") / F.col("total_ms"), 4).alias("self_share"))
    out = out.orderBy(F.desc("self_ms"), "span_id")
    return out if top is None else out.limit(top)


def slowest_spans(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n longest nodes; null counts 0."""
    return nodes.orderBy(F.coalesce("duration", F.lit(0.0)).desc(), "span_id").limit(n).select("span_id", "function_name", "duration")


def order_events(events: DataFrame) -> DataFrame:
    """W10."""
    return events.orderBy("timestamp", "span_id")


def latest_spans(spans: DataFrame, n: int = 10_000) -> DataFrame:
    """The n newest spans."""
    return spans.orderBy(F.desc("start_time_ms"), F.desc("span_id")).limit(n)


def merge_results(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """For each query_id the primary hits in order, then secondary ones with a new qualified_name."""
    both = primary.withColumn("__list", F.lit(0)).unionByName(secondary.withColumn("__list", F.lit(1)))
    first = Window.partitionBy("query_id", "qualified_name").orderBy("__list", "rank")
    kept = both.withColumn("no", F.row_number().over(first)).filter("__list = 0 or no = 1")
    order = Window.partitionBy("query_id").orderBy("__list", "rank")
    return kept.withColumn("rank", F.row_number().over(order)).drop("__list", "no")


def index_stats(units: DataFrame) -> DataFrame:
    """One row: units by type, files, log patterns, distinct tokens."""
    kinds = [F.count_if(F.col("unit_type") == k).alias(c) for k, c in (("function", "functions"), ("method", "methods"), ("class", "classes"))]
    one = units.agg(F.count("*").alias("units"), *kinds, F.count_distinct("source_file").alias("files"), F.coalesce(F.sum(F.size("log_patterns")), F.lit(0)).alias("log_patterns"))
    return one.crossJoin(units.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("unique_tokens")))


def file_breakdown(units: DataFrame, top: int = 18) -> DataFrame:
    """The files of most units, with each one's share of the largest in whole per cent."""
    made = units.groupBy("source_file").agg(
        F.count_if(F.col("unit_type").isin("function", "async_function", "method")).alias("functions"), F.count_if(F.col("unit_type") == "class").alias("classes"), F.count("*").alias("total")
    )
    best = made.orderBy(F.desc("total"), "source_file").limit(top)
    return best.crossJoin(F.broadcast(made.agg(F.max("total").alias("most")))).withColumn("pct", F.expr("total * 100 div most")).drop("most")
