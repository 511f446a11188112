"""Source trees, logs, history tables and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.schemas import ANALYSES, ANALYSIS_FINDINGS, SPAN_STATS

# Endings of the files that are read, and folders that are left out.
ENDINGS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".java", ".sql", ".yml", ".yaml", ".toml")
EXCLUDED = ("__pycache__", ".git", "venv", ".venv", "node_modules")


def read_source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Path, content of the source and config files below root; a path that holds an excluded text is left out.

    Spark's readers pass over names that begin with `.`; give `.env` files by their own path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    kept = name.startswith(".env") | F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$")
    for e in exclude:
        kept = kept & ~F.col("path").contains(e)
    return files.filter(kept).select("path", F.decode("content", "UTF-8").alias("content"))


#: Words that make a log line an error.
ERROR_WORDS = "error|exception|traceback|failed|fatal"


def classify_log_events(logs: DataFrame) -> DataFrame:
    """Log rows with a trimmed message, is_error, level and the error text."""
    message = F.trim(F.coalesce("message", F.lit("")))
    bad = F.lower(message).rlike(ERROR_WORDS)
    return logs.withColumns({"message": message, "is_error": bad, "level": F.when(bad, "ERROR").otherwise("INFO"), "error": F.when(bad, message)})


def filter_log_events(logs: DataFrame, start: int | None = None, end: int | None = None, pattern: str | None = None, limit: int = 1000) -> DataFrame:
    """The first `limit` rows by time from start to end whose message holds the pattern."""
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= start)
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= end)
    if pattern:
        logs = logs.filter(F.col("message").contains(pattern))
    return logs.orderBy("timestamp", *(c for c in ("log_stream", "message") if c in logs.columns)).limit(limit)


def write_analysis(analyses: DataFrame, span_stats: DataFrame, findings: DataFrame, path: str) -> DataFrame:
    """Append the three history tables under one id, a hash of service and timestamp; returns the analyses.

    span_stats and findings carry `service` and `timestamp` of their analysis.
    """
    ident = F.xxhash64("service", "timestamp")
    own = analyses.withColumn("id", ident)
    own.write.mode("append").partitionBy("service").parquet(f"{path}/analyses")
    for name, df in (("span_stats", span_stats), ("findings", findings)):
        df.withColumn("analysis_id", ident).drop("timestamp").write.mode("append").partitionBy("service").parquet(f"{path}/{name}")
    return own


def read_history_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Analyses, span_stats and findings with their declared columns."""
    tables = (("analyses", ANALYSES), ("span_stats", f"{SPAN_STATS}, service string"), ("findings", f"{ANALYSIS_FINDINGS}, service string"))
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in tables}


def graph_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as they are exported."""
    n = nodes.select(
        F.col("span_id").alias("id"), "function_name", F.concat_ws(":", "source_file", F.col("source_line").cast("string")).alias("source"), F.round(F.col("duration") * 1000, 2).alias("duration_ms"),
        F.coalesce(F.col("error") != "", F.lit(False)).alias("has_error"), F.col("context_id").isNotNull().alias("has_context"),
    )
    return n, edges.select(F.col("parent_id").alias("source"), F.col("child_id").alias("target"), "edge_type")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON files of nodes and edges under path."""
    for name, df in zip(("nodes", "edges"), graph_tables(nodes, edges), strict=True):
        df.write.mode("overwrite").json(f"{path}/{name}")
