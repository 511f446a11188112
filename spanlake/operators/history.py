"""History of analyses: lookups, trends, regressions, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("avg_latency_ms", "p95_latency_ms", "max_latency_ms")


def history_with_findings(analyses: DataFrame, findings: DataFrame, service: str | None = None, limit: int = 50) -> DataFrame:
    """The newest analyses, each with its findings as an array."""
    kept = analyses.filter(F.col("service") == service) if service is not None else analyses
    kept = kept.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    own = findings.join(F.broadcast(kept.select(F.col("id").alias("analysis_id"))), "analysis_id", "left_semi")
    lists = own.groupBy(F.col("analysis_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("agent_name", "finding_type", "severity", "summary", "confidence"))).alias("findings"))
    return kept.join(lists, "id", "left")


def span_trends(analyses: DataFrame, span_stats: DataFrame, service: str, name: str, limit: int = 30) -> DataFrame:
    """A span name's statistics over the newest analyses of a service."""
    own = span_stats.filter(F.col("span_name") == name)
    kept = analyses.filter(F.col("service") == service).select(F.col("id").alias("analysis_id"), "timestamp")
    return own.join(kept, "analysis_id").orderBy(F.desc("timestamp"), F.desc("analysis_id")).limit(limit)


def _halves(rows: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys)
    rows = rows.withColumns({"no": F.row_number().over(by.orderBy("timestamp", "id")), "n": F.count("*").over(by)})
    return rows.filter("n >= 2").withColumn("early", F.col("no") <= F.expr("n div 2"))


def _regressed(wide: DataFrame, threshold: float) -> DataFrame:
    out = wide.filter((F.col("baseline") > 0) & (F.col("recent") > F.col("baseline") * threshold))
    change = F.concat(F.lit("+"), F.round((F.col("recent") / F.col("baseline") - 1) * 100, 0).cast("long").cast("string"), F.lit("%"))
    return out.withColumns({"baseline": F.round("baseline", 4), "recent": F.round("recent", 4), "change": change})


def detect_regressions(analyses: DataFrame, since=None, threshold: float = 1.5) -> DataFrame:
    """Service, metric, baseline, recent, change where a metric's recent half exceeds its earlier half.

    `since` (a timestamp or other orderable literal) bounds the window; nulls and zeros don't count.
    """
    rows = analyses if since is None else analyses.filter(F.col("timestamp") >= F.lit(since))
    halves = _halves(rows, ["service"])
    value = lambda m, early: F.avg(F.when((F.col(m) != 0) & (F.col("early") == early), F.col(m)))
    wide = halves.groupBy("service").agg(*(value(m, e).alias(f"{m}_{e}") for m in METRICS for e in (True, False)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_True").alias("baseline"), F.col(f"{m}_False").alias("recent")) for m in METRICS))
    return _regressed(wide.select("service", F.inline(rows)), threshold)


def detect_span_regressions(analyses: DataFrame, span_stats: DataFrame, since=None, threshold: float = 1.5) -> DataFrame:
    """The same for each service and span name over avg_ms, zeros counted."""
    kept = analyses if since is None else analyses.filter(F.col("timestamp") >= F.lit(since))
    rows = span_stats.join(kept.select(F.col("id").alias("analysis_id"), "service", "timestamp"), "analysis_id").withColumn("id", F.col("analysis_id"))
    value = lambda early: F.avg(F.when(F.col("early") == early, F.col("avg_ms")))
    wide = _halves(rows, ["service", "span_name"]).groupBy("service", "span_name").agg(value(True).alias("baseline"), value(False).alias("recent"))
    return _regressed(wide, threshold)


def latest_session(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """The last write of each key by updated_at."""
    last = Window.partitionBy(key).orderBy(F.desc("updated_at"))
    return sessions.withColumn("no", F.row_number().over(last)).filter("no = 1").drop("no")


def history_stats(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """A10."""
    return analyses.agg(F.count("*").alias("analyses"), F.count_distinct("service").alias("services")).crossJoin(findings.agg(F.count("*").alias("findings")))


def list_services(analyses: DataFrame) -> DataFrame:
    """A11."""
    return analyses.select("service").distinct().orderBy("service")
