"""Queries over spans, trees, topology, history, findings and windows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.errors import ADVICE, OTHER_ADVICE, classify_error, recommendations_for
from spanlake.functions.text import format_traceparent, parse_traceparent
from spanlake.operators import aggregates as A
from spanlake.operators import cycles as Y
from spanlake.operators import findings as R
from spanlake.operators import graph as G
from spanlake.operators import history as H
from spanlake.operators import intervals as I
from spanlake.operators import topology as T
from spanlake.plans.views import oracle, view
from spanlake.sources import files as FS
from spanlake.sources import otlp as O
from spanlake.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def _heap(spark, d):
    return view(spark, d, "spans_heap")


def _star(spark, d):
    return view(spark, d, "spans_star")


def _nodes(spark, d):
    return view(spark, d, "nodes_heap")


# --- sources ----------------------------------------------------------------------------------------------------------


def otlp_documents(spans: DataFrame) -> DataFrame:
    """Each span as an OTLP JSON document; those of KeyErrors lose their trace id, timeouts get a bad time."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    start = (F.col("start_time_ms") * 1e6).cast("bigint")
    error = F.col("error")
    span = F.struct(
        F.when(error == "KeyError: id", "").otherwise(F.col("trace_id")).alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        F.col("name").alias("name"),
        F.lit(2).alias("kind"),
        F.when(error == "Request timed out", "soon").otherwise(start.cast("string")).alias("startTimeUnixNano"),
        (start + F.round(F.col("duration_ms") * 1e6).cast("bigint")).cast("string").alias("endTimeUnixNano"),
        F.struct(F.when(error.isNotNull(), 2).otherwise(1).alias("code"), error.alias("message")).alias("status"),
        F.array(text("thread", F.col("thread_id").cast("string"))).alias("attributes"),
    )
    scope = F.struct(F.struct(F.lit("heap").alias("name")).alias("scope"), F.array(span).alias("spans"))
    resource = F.struct(F.struct(F.array(text("service.name", F.col("service"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))
    return spans.select(F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("document"))


@query("SELECT service, 'heap' AS library, count(*) AS spans FROM spans_heap GROUP BY service")
def i01_read_otlp(spark, d):
    return O.parse_otlp(otlp_documents(_heap(spark, d))).groupBy("service", "library").agg(F.count("*").alias("spans"))


@query("SELECT coalesce(error, 'none') NOT IN ('KeyError: id', 'Request timed out') AS valid, count(*) AS spans FROM spans_heap GROUP BY 1")
def i02_validate_spans(spark, d):
    good, bad = O.validate_spans(O.parse_otlp(otlp_documents(_heap(spark, d))))
    return good.select(F.lit(True).alias("valid")).union(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("spans"))


@query("""
SELECT trace_id, span_id, parent_span_id, name, service, 'SERVER' AS kind, round(duration_ms, 2) AS duration_ms,
  CASE WHEN error IS NULL THEN 'OK' ELSE 'ERROR' END AS status, error, CAST(thread_id AS VARCHAR) AS thread
FROM spans_heap WHERE coalesce(error, 'none') NOT IN ('KeyError: id', 'Request timed out')""")
def i03_normalize_spans(spark, d):
    s = O.normalize_spans(O.validate_spans(O.parse_otlp(otlp_documents(_heap(spark, d))))[0])
    return s.select("trace_id", "span_id", "parent_span_id", "name", "service", "kind", "duration_ms", "status", "error", F.col("attributes")["thread"].alias("thread"))


@query("""
SELECT 'EXIT' AS event_type, span_id, trace_id AS context_id, duration_ms / 1000 AS duration, NULL::VARCHAR AS error FROM spans_heap
UNION ALL SELECT 'ERROR', span_id, trace_id, NULL, error FROM spans_heap WHERE error IS NOT NULL""")
def i04_spans_to_events(spark, d):
    return O.spans_to_trace_events(_heap(spark, d)).select("event_type", "span_id", "context_id", "duration", "error")


def _logs(spark, d):
    return view(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"), F.col("text").alias("message"), F.col("role").alias("log_stream"))


@query("""
SELECT conv_id * 1000 + turn AS timestamp, role AS log_stream, regexp_matches(lower(text), 'error|exception|traceback|failed|fatal') AS is_error,
  CASE WHEN regexp_matches(lower(text), 'error|exception|traceback|failed|fatal') THEN 'ERROR' ELSE 'INFO' END AS level FROM conversations""")
def i06_classify_logs(spark, d):
    return FS.classify_log_events(_logs(spark, d)).select("timestamp", "log_stream", "is_error", "level")


@query("""
SELECT conv_id * 1000 + turn AS timestamp, role AS log_stream FROM conversations
WHERE conv_id * 1000 + turn BETWEEN 10000 AND 5000000 AND contains(text, 'the') ORDER BY timestamp, role, text LIMIT 500""")
def i07_filter_logs(spark, d):
    return FS.filter_log_events(_logs(spark, d), 10_000, 5_000_000, "the", 500).select("timestamp", "log_stream")


def _analyses(spark, d):
    return view(spark, d, "analyses_daily").withColumn("timestamp", F.col("day"))


def _span_stats(spark, d):
    """Statistics by service and day for analyses_daily, for two span names."""
    v = view(spark, d, "values_daily").withColumn("span_name", F.when(F.col("v") > 10, "slow").otherwise("fast"))
    return v.groupBy(F.concat("service", F.lit(":"), F.col("day").cast("string")).alias("analysis_id"), "span_name").agg(F.count("*").alias("count"), F.round(F.avg("v"), 6).alias("avg_ms"), F.round(F.max("v"), 6).alias("max_ms"))


_STATS = """
stats AS (SELECT concat(service, ':', day) AS analysis_id, CASE WHEN v > 10 THEN 'slow' ELSE 'fast' END AS span_name, count(*) AS count, round(avg(v), 6) AS avg_ms, round(max(v), 6) AS max_ms
  FROM values_daily GROUP BY ALL)"""


def _daily_findings(spark, d):
    a = _analyses(spark, d).filter("error_count > 0 or max_latency_ms > 100")
    return a.select(F.col("id").alias("analysis_id"), F.lit("MetricsCorrelationAgent").alias("agent_name"), F.lit("performance_anomaly").alias("finding_type"), F.lit("medium").alias("severity"), F.concat(F.lit("max over "), F.col("service")).alias("summary"), F.lit(0.9).alias("confidence"))


_FINDINGS = "fnd AS (SELECT id AS analysis_id, concat('max over ', service) AS summary FROM analyses_daily WHERE error_count > 0 OR max_latency_ms > 100)"


@query("SELECT service, count(*) AS analyses, sum(total_spans)::BIGINT AS spans FROM analyses_daily GROUP BY service")
def i08_write_history(spark, d):
    """The tables are written to a new shared folder and read again."""
    a = _analyses(spark, d).withColumn("timestamp", F.timestamp_millis(F.col("day") * 86_400_000)).drop("id", "day")
    a = a.select("timestamp", "service", F.col("total_spans").cast("int").alias("total_spans"), F.col("error_count").cast("int").alias("error_count"), "avg_latency_ms", "p95_latency_ms", "max_latency_ms")
    path = G.shared_folder(spark, "history")
    stats = a.select("service", "timestamp", F.lit("all").alias("span_name"), F.col("total_spans").cast("bigint").alias("count"), F.col("avg_latency_ms").alias("avg_ms"), F.col("max_latency_ms").alias("max_ms"))
    found = a.filter("error_count > 0").select("service", "timestamp", F.lit("agent").alias("agent_name"), F.lit("error_trace").alias("finding_type"), F.lit("low").alias("severity"), F.lit("errors").alias("summary"), F.lit(0.5).alias("confidence"))
    FS.write_analysis(a, stats, found, path)
    read = FS.read_history_tables(spark, path)
    return read["analyses"].join(read["span_stats"], F.col("id") == F.col("analysis_id")).groupBy(read["analyses"]["service"]).agg(F.count("*").alias("analyses"), F.sum("total_spans").alias("spans"))


@query("""
SELECT span_id AS id, function_name, concat(source_file, ':', source_line) AS source, round(duration * 1000, 2) AS duration_ms, error IS NOT NULL AS has_error, context_id IS NOT NULL AS has_context
FROM nodes_heap""")
def i11_graph_nodes(spark, d):
    n = _nodes(spark, d)
    return FS.graph_tables(n, G.link_parents(n))[0]


@query("""
SELECT p.span_id AS source, c.span_id AS target, CASE WHEN p.thread_id <> c.thread_id THEN 'cross_thread' ELSE 'call' END AS edge_type
FROM nodes_heap c JOIN nodes_heap p ON c.parent_span_id = p.span_id""")
def i11_graph_edges(spark, d):
    n = _nodes(spark, d)
    return FS.graph_tables(n, G.link_parents(n))[1]


# --- functions --------------------------------------------------------------------------------------------------------

_KIND = """CASE WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout'
  WHEN lower(error) LIKE '%connection%' OR lower(error) LIKE '%refused%' OR lower(error) LIKE '%unavailable%' THEN 'connection_error'
  WHEN lower(error) LIKE '%key%' OR lower(error) LIKE '%index%' OR lower(error) LIKE '%attribute%' THEN 'data_error'
  WHEN lower(error) LIKE '%context%' OR lower(error) LIKE '%propagat%' THEN 'context_loss' ELSE 'error_trace' END"""


@query(f"SELECT span_id, {_KIND} AS kind FROM spans_star WHERE error IS NOT NULL")
def f01_classify_error(spark, d):
    return _star(spark, d).filter("error is not null").select("span_id", classify_error(F.col("error")).alias("kind"))


@query(f"""
SELECT c.span_id, CASE WHEN p.span_id IS NULL THEN 'critical' WHEN ({_KIND.replace("error)", "c.error)")}) IN ('timeout', 'connection_error') THEN 'high' ELSE 'medium' END AS severity
FROM spans_heap c LEFT JOIN spans_heap p ON c.parent_span_id = p.span_id WHERE c.error IS NOT NULL""")
def f02_assess_severity(spark, d):
    n = _nodes(spark, d)
    degree = G.link_parents(n).groupBy(F.col("child_id").alias("span_id")).agg(F.count("*").alias("k"))
    from spanlake.functions.errors import assess_severity

    return G.find_errors(n).join(degree, "span_id", "left").select("span_id", assess_severity(F.col("error"), F.coalesce("k", F.lit(0))).alias("severity"))


@query(f"SELECT span_id, CASE WHEN ({_KIND}) = 'error_trace' THEN 2 ELSE 3 END AS texts FROM spans_heap WHERE error IS NOT NULL")
def f03_recommendations(spark, d):
    return _heap(spark, d).filter("error is not null").select("span_id", F.size(recommendations_for(classify_error(F.col("error")))).alias("texts"))


@query("""
SELECT event_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS context_id, substr(h, 1, 16) AS parent_id,
  concat('00-', h, '-', rpad(CAST(event_id AS VARCHAR), 16, '0'), '-01') AS header FROM (SELECT event_id, md5(props) AS h FROM events) e""")
def f16_traceparent(spark, d):
    e = view(spark, d, "events").select("event_id", F.md5(F.col("props").cast("binary")).alias("h"))
    p = parse_traceparent(F.concat(F.lit("00-"), "h", F.lit("-"), F.substring("h", 1, 16), F.lit("-01")))
    return e.select("event_id", p["context_id"].alias("context_id"), p["parent_id"].alias("parent_id"), format_traceparent(p["context_id"], F.col("event_id").cast("string")).alias("header"))


# --- aggregates -------------------------------------------------------------------------------------------------------

_P95 = "max(CASE WHEN rn = least(n * 95 // 100 + 1, n) THEN d END)"
_A01 = "SELECT name, count(*) AS count, round(avg(duration_ms), 4) AS avg_ms, max(duration_ms) AS max_ms, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 6) AS error_rate FROM {} GROUP BY name"


@query(_A01.format("spans_heap"))
def a01_span_stats(spark, d):
    return A.span_stats(_heap(spark, d))


@query(_A01.format("spans_star"))
def a01_span_stats_star(spark, d):
    return A.span_stats(_star(spark, d))


def _summary(table: str, key: str, zero: bool = False) -> str:
    value = "CASE WHEN duration_ms <> 0 THEN duration_ms END" if zero else "duration_ms"
    return f"""
WITH r AS (SELECT *, {value} AS d FROM {table}),
k AS (SELECT {key}, d, row_number() OVER (PARTITION BY {key} ORDER BY d) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM r WHERE d IS NOT NULL),
p AS (SELECT {key}, {_P95} AS p95_ms FROM k GROUP BY {key})
SELECT r.{key}, count(*) AS total_spans, count(DISTINCT trace_id) AS total_traces, count(error) AS error_count, round(avg(r.d), 4) AS avg_ms, max(r.d) AS max_ms, any_value(p.p95_ms) AS p95_ms
FROM r LEFT JOIN p ON r.{key} = p.{key} GROUP BY r.{key}"""


@query(_summary("spans_star", "service"))
def a02_latency_summary(spark, d):
    return A.latency_summary(_star(spark, d), ["service"])


@query(_summary("spans_heap", "name", True))
def a02_latency_by_name(spark, d):
    return A.latency_summary(_heap(spark, d), ["name"], exclude_zero=True)


@query(f"""
WITH r AS (SELECT *, CASE WHEN duration_ms <> 0 THEN duration_ms END AS d FROM spans_star),
k AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM r WHERE d IS NOT NULL)
SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT name) AS operations, count(DISTINCT service) AS services, round(avg(d), 4) AS avg_ms, count(error) AS errors,
  max(d) AS max_ms, round(sum(d), 2) AS total_ms, (SELECT {_P95} FROM k) AS p95_ms FROM r""")
def a03_telemetry_overview(spark, d):
    return A.telemetry_overview(_star(spark, d))


@query("""
SELECT name, CASE WHEN count(error) > 0 THEN 'failed' ELSE 'success' END AS outcome, arg_max(error, {'a': start_time_ms, 'b': span_id}) FILTER (error IS NOT NULL) AS last_error
FROM spans_star GROUP BY name""")
def a04_operation_outcomes(spark, d):
    return A.operation_outcomes(_star(spark, d))


@query("SELECT error, count(*) AS count, concat(error, ' (x', count(*), ')') AS label FROM spans_star WHERE error IS NOT NULL GROUP BY error")
def a05_error_histogram(spark, d):
    return A.error_histogram(_star(spark, d))


@query("""
SELECT trace_id, count(*) AS spans, CASE WHEN count(error) > 0 THEN 'ERROR' ELSE 'OK' END AS status, max(CASE WHEN parent_span_id IS NULL THEN duration_ms END) AS duration_ms FROM spans_star GROUP BY trace_id""")
def a06_trace_summary(spark, d):
    return A.trace_summary(_star(spark, d))


@query("""
WITH k AS (SELECT function_name, duration AS d, row_number() OVER (PARTITION BY function_name ORDER BY duration) AS rn, count(*) OVER (PARTITION BY function_name) AS n FROM nodes_heap WHERE duration <> 0),
m AS (SELECT function_name, max(n) AS n, max(CASE WHEN rn = n // 2 + 1 THEN d END) AS median, max(d) AS largest FROM k GROUP BY 1)
SELECT m.function_name, round(median * 1000, 4) AS median_ms, round(largest * 1000, 4) AS max_ms, count(CASE WHEN d <= 2 * median THEN 1 END) AS fast, count(CASE WHEN d > 2 * median THEN 1 END) AS slow
FROM m JOIN k USING (function_name) WHERE m.n >= 4 AND median > 0 AND largest / median > 5 GROUP BY ALL HAVING slow >= 1""")
def a07_bimodal_operations(spark, d):
    return A.bimodal_operations(_nodes(spark, d))


@query(f"WITH {_FINDINGS} SELECT (SELECT count(*) FROM analyses_daily) AS analyses, (SELECT count(DISTINCT service) FROM analyses_daily) AS services, (SELECT count(*) FROM fnd) AS findings")
def a10_history_stats(spark, d):
    return H.history_stats(_analyses(spark, d), _daily_findings(spark, d))


@query("SELECT DISTINCT service FROM analyses_daily")
def a11_list_services(spark, d):
    return H.list_services(_analyses(spark, d))


@query("""
WITH e AS (SELECT p.span_id AS p, c.span_id AS c, p.thread_id <> c.thread_id AS x FROM nodes_heap c JOIN nodes_heap p ON c.parent_span_id = p.span_id)
SELECT (SELECT count(*) FROM nodes_heap) AS spans, (SELECT count(DISTINCT context_id) FROM nodes_heap) AS contexts, (SELECT count(*) FROM nodes_heap) - (SELECT count(DISTINCT c) FROM e) AS roots,
  (SELECT count(*) FROM (SELECT p FROM e GROUP BY p HAVING count(*) > 1)) AS branching_points, (SELECT count(*) FROM e WHERE x) AS cross_thread_edges,
  (SELECT count(*) FROM nodes_heap WHERE context_id IS NULL) AS gaps, (SELECT count(error) FROM nodes_heap) AS errors""")
def a12_graph_summary(spark, d):
    n = _nodes(spark, d)
    return G.graph_summary(n, G.link_parents(n))


# --- joins, windows ---------------------------------------------------------------------------------------------------


@query("""
SELECT p.span_id AS parent_id, c.span_id AS child_id, CASE WHEN p.thread_id <> c.thread_id THEN 'cross_thread' ELSE 'call' END AS edge_type
FROM nodes_heap c JOIN nodes_heap p ON c.parent_span_id = p.span_id""")
def j01_link_parents(spark, d):
    return G.link_parents(_nodes(spark, d))


@query("SELECT span_id FROM spans_star WHERE parent_span_id IS NULL OR parent_span_id NOT IN (SELECT span_id FROM spans_star)")
def j02_orphan_or_root(spark, d):
    return G.orphan_or_root(_star(spark, d)).select("span_id")


@query("SELECT p.service AS source, c.service AS target, c.duration_ms, c.error FROM spans_star c JOIN spans_star p ON c.parent_span_id = p.span_id WHERE p.service <> c.service")
def j03_service_edges(spark, d):
    return T.service_edges(_star(spark, d))


@query(f"""
WITH {_FINDINGS}, top AS (SELECT * FROM analyses_daily WHERE service = 'error' ORDER BY day DESC, id DESC LIMIT 20)
SELECT t.id, t.day, count(f.summary) AS findings FROM top t LEFT JOIN fnd f ON f.analysis_id = t.id GROUP BY ALL""")
def j04_history_with_findings(spark, d):
    out = H.history_with_findings(_analyses(spark, d), _daily_findings(spark, d), "error", 20)
    return out.select("id", "day", F.coalesce(F.size("findings"), F.lit(0)).cast("bigint").alias("findings"))


@query(f"WITH {_STATS} SELECT analysis_id, s.avg_ms, s.max_ms, s.count FROM stats s JOIN analyses_daily a ON a.id = s.analysis_id WHERE span_name = 'slow' AND a.service = 'click' ORDER BY a.day DESC LIMIT 10")
def j05_span_trends(spark, d):
    return H.span_trends(_analyses(spark, d), _span_stats(spark, d), "click", "slow", 10).select("analysis_id", "avg_ms", "max_ms", "count")


_CLOSURE = """cl AS (SELECT span_id, span_id AS ancestor_id, 0 AS distance FROM nodes_heap
  UNION ALL SELECT cl.span_id, n.parent_span_id, cl.distance + 1 FROM cl JOIN nodes_heap n ON n.span_id = cl.ancestor_id WHERE n.parent_span_id IS NOT NULL)"""


@query(f"""
WITH RECURSIVE {_CLOSURE}
SELECT ancestor_id AS root_id, cl.span_id AS affected_id, distance::BIGINT AS distance FROM cl JOIN nodes_heap a ON a.span_id = ancestor_id JOIN nodes_heap b ON b.span_id = cl.span_id
WHERE distance > 0 AND a.error IS NOT NULL AND b.error IS NOT NULL""")
def j08_cascading_intervals(spark, d):
    """J08 by pre-order intervals instead of the closure."""
    return I.cascading_failures(_nodes(spark, d))


@query(f"""
WITH RECURSIVE {_CLOSURE}
SELECT ancestor_id AS root_id, cl.span_id AS affected_id, distance::BIGINT AS distance FROM cl JOIN nodes_heap a ON a.span_id = ancestor_id JOIN nodes_heap b ON b.span_id = cl.span_id
WHERE distance > 0 AND a.error IS NOT NULL AND b.error IS NOT NULL""")
def j08_cascading_failures(spark, d):
    n = _nodes(spark, d)
    return G.cascading_failures(n, G.ancestor_closure(n, G.find_errors(n)))


@query("""
WITH s AS (SELECT function_name, count(*) AS n, avg(duration * 1000) AS mean, stddev_pop(duration * 1000) AS sigma FROM nodes_heap WHERE duration <> 0 GROUP BY 1)
SELECT span_id, function_name, round(duration * 1000, 4) AS duration_ms, n FROM nodes_heap JOIN s USING (function_name)
WHERE duration <> 0 AND CASE WHEN n >= 3 THEN sigma > 5 AND duration * 1000 > mean + 2 * sigma ELSE duration * 1000 > 100 END""")
def w01_statistical_outliers(spark, d):
    return A.statistical_outliers(_nodes(spark, d))


_SELF = """
SELECT n.span_id, function_name, round(duration * 1000, 4) AS total_ms, round(duration * 1000 - coalesce(c, 0), 4) AS self_ms, round(coalesce(c, 0), 4) AS child_ms, round((duration * 1000 - coalesce(c, 0)) / (duration * 1000), 4) AS self_share
FROM nodes_heap n LEFT JOIN (SELECT parent_span_id AS span_id, sum(duration * 1000) AS c FROM nodes_heap WHERE parent_span_id IS NOT NULL AND duration IS NOT NULL GROUP BY 1) k USING (span_id)
WHERE duration <> 0 AND duration * 1000 >= 100 AND (duration * 1000 - coalesce(c, 0)) / (duration * 1000) > 0.6 AND duration * 1000 - coalesce(c, 0) > 50"""


@query(_SELF + " ORDER BY self_ms DESC, n.span_id LIMIT 5")
def w02_self_time(spark, d):
    return A.self_time(_nodes(spark, d))


@query(_SELF)
def w02_self_time_all(spark, d):
    return A.self_time(_nodes(spark, d), top=None)


@query("SELECT span_id, function_name, duration FROM nodes_heap ORDER BY coalesce(duration, 0) DESC, span_id LIMIT 10")
def w03_slowest_spans(spark, d):
    return A.slowest_spans(_nodes(spark, d))


def _regressed(columns: str) -> str:
    return f"""
SELECT {columns}, round(baseline, 4) AS baseline, round(recent, 4) AS recent, concat('+', CAST(round((recent / baseline - 1) * 100) AS BIGINT), '%') AS change
FROM w WHERE baseline > 0 AND recent > baseline * 1.5"""


@query(
    """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY day, id) AS no, count(*) OVER (PARTITION BY service) AS n FROM analyses_daily),
u AS (SELECT service, no <= n // 2 AS early, n, unnest(['avg_latency_ms', 'p95_latency_ms', 'max_latency_ms']) AS metric, unnest([avg_latency_ms, p95_latency_ms, max_latency_ms]) AS v FROM h),
w AS (SELECT service, metric, avg(CASE WHEN early AND v <> 0 THEN v END) AS baseline, avg(CASE WHEN NOT early AND v <> 0 THEN v END) AS recent FROM u WHERE n >= 2 GROUP BY ALL)"""
    + _regressed("service, metric")
)
def w04_detect_regressions(spark, d):
    return H.detect_regressions(_analyses(spark, d))


@query(
    f"""
WITH {_STATS},
h AS (SELECT a.service, s.span_name, s.avg_ms, row_number() OVER (PARTITION BY a.service, span_name ORDER BY a.day, a.id) AS no, count(*) OVER (PARTITION BY a.service, span_name) AS n FROM stats s JOIN analyses_daily a ON a.id = s.analysis_id),
w AS (SELECT service, span_name, avg(CASE WHEN no <= n // 2 THEN avg_ms END) AS baseline, avg(CASE WHEN no > n // 2 THEN avg_ms END) AS recent FROM h WHERE n >= 2 GROUP BY ALL)"""
    + _regressed("service, span_name")
)
def w05_span_regressions(spark, d):
    return H.detect_span_regressions(_analyses(spark, d), _span_stats(spark, d))


@query("SELECT user_id AS session_id, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) e WHERE ts = m GROUP BY 1")
def w06_latest_session(spark, d):
    s = view(spark, d, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("updated_at"), "event_id")
    return H.latest_session(s).select("session_id", "event_id")


@query("SELECT event_id AS span_id, (epoch_us(ts) // 1000)::DOUBLE AS timestamp FROM events")
def w10_order_events(spark, d):
    e = view(spark, d, "events").select(F.col("event_id").alias("span_id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"))
    return A.order_events(e)


@query("SELECT span_id, name FROM spans_star ORDER BY start_time_ms DESC, span_id DESC LIMIT 10000")
def w11_latest_spans(spark, d):
    return A.latest_spans(_star(spark, d)).select("span_id", "name")


# --- graph ------------------------------------------------------------------------------------------------------------


def _events(spark, d):
    """The heap's spans as ENTRY, EXIT and ERROR events; failed spans of thread 0 lose their EXIT."""
    n = _nodes(spark, d)
    base = n.select("span_id", "function_name", "module", "source_file", "source_line", "context_id", "parent_span_id", F.lit(0).alias("depth"), "thread_id", "thread_name", "start_time", "duration", "error")
    lost = F.col("error").isNotNull() & (F.col("thread_id") == 0)
    kinds = F.array_compact(F.array(F.lit("ENTRY"), F.when(~lost, F.lit("EXIT")), F.when(F.col("error").isNotNull(), F.lit("ERROR"))))
    e = base.withColumn("event_type", F.explode(kinds))
    exit_ = F.col("event_type") == "EXIT"
    return e.withColumns(
        {"timestamp": F.col("start_time") + F.when(F.col("event_type") == "ENTRY", 0.0).otherwise(F.col("duration")), "duration": F.when(exit_, F.col("duration")), "error": F.when(F.col("event_type") == "ERROR", F.col("error"))}
    ).drop("start_time")


@query("""
SELECT span_id, function_name, parent_span_id, thread_id, start_time, CASE WHEN error IS NULL OR thread_id <> 0 THEN duration END AS duration, error, context_id IS NOT NULL AS has_context FROM nodes_heap""")
def g01_build_span_nodes(spark, d):
    return G.build_span_nodes(_events(spark, d)).select("span_id", "function_name", "parent_span_id", "thread_id", "start_time", "duration", "error", "has_context")


@query("SELECT span_id, 'root' AS kind FROM nodes_heap WHERE parent_span_id IS NULL UNION ALL SELECT span_id, 'leaf' FROM nodes_heap WHERE span_id NOT IN (SELECT parent_span_id FROM nodes_heap WHERE parent_span_id IS NOT NULL)")
def g03_roots_and_leaves(spark, d):
    n = _nodes(spark, d)
    e = G.link_parents(n)
    return G.find_roots(n, e).select("span_id", F.lit("root").alias("kind")).union(G.find_leaves(n, e).select("span_id", F.lit("leaf").alias("kind")))


@query("SELECT span_id FROM nodes_heap WHERE context_id IS NULL")
def g04_context_gaps(spark, d):
    return G.find_context_gaps(_nodes(spark, d)).select("span_id")


@query("SELECT p.span_id AS parent_id, c.span_id AS child_id FROM nodes_heap c JOIN nodes_heap p ON c.parent_span_id = p.span_id WHERE p.thread_id <> c.thread_id")
def g05_cross_thread_edges(spark, d):
    return G.find_cross_thread_edges(G.link_parents(_nodes(spark, d))).select("parent_id", "child_id")


@query("SELECT span_id, error FROM nodes_heap WHERE error IS NOT NULL")
def g06_errors(spark, d):
    return G.find_errors(_nodes(spark, d)).select("span_id", "error")


@query(f"WITH RECURSIVE {_CLOSURE} SELECT span_id, ancestor_id, distance::BIGINT AS distance FROM cl")
def g07_ancestor_closure(spark, d):
    return G.ancestor_closure(_nodes(spark, d))


@query(f"""
WITH RECURSIVE {_CLOSURE}
SELECT cl.span_id, string_agg(n.function_name, ' > ' ORDER BY distance DESC) AS chain FROM cl JOIN nodes_heap n ON n.span_id = ancestor_id
WHERE cl.span_id IN (SELECT span_id FROM nodes_heap WHERE error IS NOT NULL) GROUP BY 1""")
def g08_causal_chain(spark, d):
    n = _nodes(spark, d)
    return G.causal_chain(n, G.ancestor_closure(n, G.find_errors(n))).select("span_id", F.array_join("chain", " > ").alias("chain"))


@query("SELECT c.span_id AS child_id, p.span_id AS parent_id FROM nodes_heap c JOIN nodes_heap p ON c.parent_span_id = p.span_id WHERE c.context_id = 'u1' AND p.context_id = 'u1'")
def g09_context_subgraph(spark, d):
    n = _nodes(spark, d)
    return G.context_subgraph(n, G.link_parents(n), "u1")[1].select("child_id", "parent_id")


@query("SELECT parent_span_id AS span_id, count(*) AS degree FROM spans_star WHERE parent_span_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def g10_branching_points(spark, d):
    return G.branching_points(G.link_parents(_star(spark, d)))


@query("SELECT b AS span_id, count(*) AS degree FROM edges_docs GROUP BY b HAVING count(*) > 1")
def g10_convergence_points(spark, d):
    return G.convergence_points(view(spark, d, "edges_docs").select(F.col("a").alias("parent_id"), F.col("b").alias("child_id")))


@query(f"""
WITH RECURSIVE {_CLOSURE},
s AS (SELECT cl.span_id, round(sum(coalesce(n.duration, 0)), 6) AS total, arg_max(ancestor_id, distance) AS root_id FROM cl JOIN nodes_heap n ON n.span_id = ancestor_id GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY total DESC, span_id) AS no FROM s WHERE span_id NOT IN (SELECT parent_span_id FROM nodes_heap WHERE parent_span_id IS NOT NULL))
SELECT root_id, l.span_id AS leaf_id, any_value(total) AS total, string_agg(n.function_name, ' > ' ORDER BY distance DESC) AS path
FROM l JOIN cl ON cl.span_id = l.span_id JOIN nodes_heap n ON n.span_id = ancestor_id WHERE no = 1 GROUP BY ALL""")
def g11_critical_path(spark, d):
    n = _nodes(spark, d)
    return G.critical_path(n).select("root_id", "leaf_id", "total", F.array_join("path", " > ").alias("path"))


@query("""
SELECT service, count(*) AS span_count, count(error) AS error_count, round(avg(duration_ms), 1) AS avg_ms, string_agg(DISTINCT name, ',' ORDER BY name) AS endpoints FROM spans_star GROUP BY service""")
def g12_service_nodes(spark, d):
    return T.service_nodes(_star(spark, d)).withColumn("endpoints", F.array_join("endpoints", ","))


@query("""
SELECT p.service AS source, c.service AS target, count(*) AS call_count, count(c.error) AS error_count, round(avg(c.duration_ms), 1) AS avg_ms
FROM spans_star c JOIN spans_star p ON c.parent_span_id = p.span_id WHERE p.service <> c.service GROUP BY ALL""")
def g12_service_edges(spark, d):
    return T.service_topology(_star(spark, d))[1]


@query("""
SELECT (SELECT count(DISTINCT service) FROM spans_star) AS services, (SELECT count(*) FROM spans_star) AS total_spans,
  (SELECT count(*) FROM (SELECT DISTINCT p.service, c.service AS s FROM spans_star c JOIN spans_star p ON c.parent_span_id = p.span_id WHERE p.service <> c.service)) AS dependencies""")
def g13_topology_summary(spark, d):
    return T.topology_summary(*T.service_topology(_star(spark, d)))


@query(f"""
WITH RECURSIVE {_CLOSURE}
SELECT cl.span_id, max(distance)::BIGINT AS depth, string_agg(concat(lpad(CAST(CAST(n.start_time AS DECIMAL(18, 3)) AS VARCHAR), 20, '0'), '|', n.span_id), '/' ORDER BY distance DESC) AS sort_path
FROM cl JOIN nodes_heap n ON n.span_id = ancestor_id GROUP BY 1""")
def g14_render_depth(spark, d):
    n = _nodes(spark, d)
    return G.render_depth(n, G.ancestor_closure(n))


@query("""
WITH RECURSIVE p AS (SELECT a AS s, b AS e, [a, b] AS path FROM edges_docs WHERE a < b
  UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN edges_docs ON a = e WHERE b >= s AND e <> s AND NOT list_contains(path[2:], b) AND len(path) <= 6)
SELECT DISTINCT array_to_string(list_sort(list_distinct(path)), ',') AS members, len(path) - 1 AS length FROM p WHERE e = s""")
def g15_find_cycles(spark, d):
    c = G.find_cycles(view(spark, d, "edges_docs"))
    return c.select(F.array_join(c.members.cast("array<string>"), ",").alias("members"), F.col("length").cast("bigint").alias("length"))


@query(f"""
WITH RECURSIVE {_CLOSURE},
p AS (SELECT cl.span_id, max_by(ancestor_id, distance) AS root_id, max(distance)::BIGINT AS depth, string_agg(concat(lpad(CAST(CAST(n.start_time AS DECIMAL(18, 3)) AS VARCHAR), 20, '0'), '|', n.span_id), '/' ORDER BY distance DESC) AS sort_path
  FROM cl JOIN nodes_heap n ON n.span_id = ancestor_id GROUP BY 1),
k AS (SELECT ancestor_id AS span_id, count(*) AS n FROM cl GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY sort_path) - 1 AS pre FROM p JOIN k USING (span_id))
SELECT span_id, root_id, pre, pre + n - 1 AS last, depth FROM o""")
def g14_tree_intervals(spark, d):
    return I.tree_intervals(_nodes(spark, d))


_COMPONENTS = """r AS (SELECT a, b FROM edges_docs UNION SELECT r.a, e.b FROM r JOIN edges_docs e ON e.a = r.b),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM comp")
def g15_strong_components(spark, d):
    return Y.strong_components(view(spark, d, "edges_docs"))


@query(f"""
WITH RECURSIVE {_COMPONENTS},
s AS (SELECT x.component, a, min(b) AS b FROM edges_docs JOIN comp x ON x.node = a JOIN comp y ON y.node = b AND y.component = x.component GROUP BY 1, 2),
w AS (SELECT a AS v, b AS e FROM s UNION SELECT w.v, s.b FROM w JOIN s ON w.e = s.a),
leader AS (SELECT component, min(v) AS first FROM w JOIN s ON s.a = v WHERE e = v GROUP BY 1),
c AS (SELECT component, CAST(0 AS BIGINT) AS position, first AS node, first FROM leader UNION ALL SELECT c.component, position + 1, s.b, c.first FROM c JOIN s ON s.a = c.node WHERE s.b <> c.first)
SELECT component, position, node FROM c""")
def g15_witness_cycles(spark, d):
    edges = view(spark, d, "edges_docs")
    return Y.witness_cycles(edges, Y.strong_components(edges))


@query("""
WITH RECURSIVE p AS (SELECT a AS s, b AS e, [a, b] AS path FROM edges_docs UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN edges_docs ON a = e WHERE NOT list_contains(path, b) AND len(path) <= 11)
SELECT DISTINCT s AS start FROM p WHERE len(path) = 12""")
def g16_deep_call_chains(spark, d):
    return Y.deep_call_chains(view(spark, d, "edges_docs"))


# --- findings ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {_CLOSURE},
e AS (SELECT c.*, p.span_id AS up FROM nodes_heap c LEFT JOIN nodes_heap p ON c.parent_span_id = p.span_id WHERE c.error IS NOT NULL)
SELECT trace_id AS investigation_id, e.span_id, {_KIND} AS finding_type, CASE WHEN up IS NULL THEN 'critical' WHEN ({_KIND}) IN ('timeout', 'connection_error') THEN 'high' ELSE 'medium' END AS severity,
  0.85::DOUBLE AS confidence, concat(source_file, ':', source_line) AS location FROM e""")
def r01_error_findings(spark, d):
    n = _nodes(spark, d)
    f = R.error_findings(n, G.link_parents(n))
    return f.select("investigation_id", F.col("affected_spans")[0].alias("span_id"), "finding_type", "severity", "confidence", F.col("source_locations")[0].alias("location"))


@query("SELECT trace_id AS investigation_id, count(*) AS spans, string_agg(span_id, ',' ORDER BY span_id) AS affected FROM nodes_heap WHERE context_id IS NULL GROUP BY 1")
def r02_context_loss(spark, d):
    f = R.context_loss_finding(_nodes(spark, d))
    return f.select("investigation_id", F.size("affected_spans").cast("bigint").alias("spans"), F.array_join("affected_spans", ",").alias("affected"))


@query(f"""
WITH RECURSIVE {_CLOSURE}, x AS (SELECT DISTINCT b.trace_id FROM cl JOIN nodes_heap a ON a.span_id = ancestor_id JOIN nodes_heap b ON b.span_id = cl.span_id WHERE distance > 0 AND a.error IS NOT NULL AND b.error IS NOT NULL)
SELECT trace_id AS investigation_id, count(*) AS spans, 'high' AS severity, 0.8::DOUBLE AS confidence FROM nodes_heap JOIN x USING (trace_id) WHERE error IS NOT NULL GROUP BY 1""")
def r03_cascade(spark, d):
    n = _nodes(spark, d)
    return R.cascade_finding(n, G.ancestor_closure(n, G.find_errors(n))).select("investigation_id", F.size("affected_spans").cast("bigint").alias("spans"), "severity", "confidence")


@query()
def r04_performance_findings(spark, d):
    n = _nodes(spark, d)
    return R.performance_findings(n, G.link_parents(n), G.ancestor_closure(n)).select("investigation_id", "finding_type", "severity", "summary", "confidence")


def _found(spark, d):
    """Findings of two agents over the heap, as errors and outliers."""
    n = _nodes(spark, d)
    out = A.statistical_outliers(n).join(n.select("span_id", "trace_id"), "span_id")
    slow = R._finding(out, "trace_id", agent="MetricsCorrelationAgent", type="performance_anomaly", severity="medium", summary=F.concat(F.lit("slow "), "span_id"), spans=F.array("span_id"), confidence=0.9, advice=["Profile it"])
    return R.error_findings(n, G.link_parents(n)).unionByName(slow)


_FOUND = f"""
st AS (SELECT function_name, count(*) AS n, avg(duration * 1000) AS mean, stddev_pop(duration * 1000) AS sigma FROM nodes_heap WHERE duration <> 0 GROUP BY 1),
fd AS (
  SELECT c.trace_id AS investigation_id, c.span_id, 'LogAnalysisAgent' AS agent, {_KIND.replace("error)", "c.error)")} AS kind, 0.85 AS confidence,
    CASE WHEN p.span_id IS NULL THEN 4 WHEN ({_KIND.replace("error)", "c.error)")}) IN ('timeout', 'connection_error') THEN 3 ELSE 2 END AS rank
  FROM nodes_heap c LEFT JOIN nodes_heap p ON c.parent_span_id = p.span_id WHERE c.error IS NOT NULL
  UNION ALL SELECT trace_id, span_id, 'MetricsCorrelationAgent', 'performance_anomaly', 0.9, 2 FROM nodes_heap JOIN st USING (function_name)
  WHERE duration <> 0 AND CASE WHEN n >= 3 THEN sigma > 5 AND duration * 1000 > mean + 2 * sigma ELSE duration * 1000 > 100 END)"""


@query(f"WITH {_FOUND} SELECT investigation_id, max(rank)::INT AS rank, max(confidence) FILTER (rank = m)::DOUBLE AS confidence FROM (SELECT *, max(rank) OVER (PARTITION BY investigation_id) AS m FROM fd) x GROUP BY 1")
def r05_primary_finding(spark, d):
    return R.primary_finding(_found(spark, d)).select("investigation_id", R.severity_rank(F.col("severity")).alias("rank"), "confidence")


_CONFLICT = "cf AS (SELECT DISTINCT a.investigation_id, a.span_id FROM fd a JOIN fd b ON a.span_id = b.span_id AND a.agent < b.agent AND a.kind <> b.kind)"


@query(f"WITH {_FOUND}, {_CONFLICT} SELECT investigation_id, count(*) AS findings, round(avg(confidence) * CASE WHEN investigation_id IN (SELECT investigation_id FROM cf) THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS confidence FROM fd GROUP BY 1")
def r06_overall_confidence(spark, d):
    f = _found(spark, d)
    return R.overall_confidence(f, R.conflicting_findings(f))


@query(f"WITH {_FOUND}, {_CONFLICT} SELECT investigation_id, count(*) AS pairs FROM cf GROUP BY 1")
def j07_conflicting_findings(spark, d):
    return R.conflicting_findings(_found(spark, d)).groupBy("investigation_id").agg(F.count("*").alias("pairs"))


@query()
def r07_rca_report(spark, d):
    n = _nodes(spark, d)
    r = R.investigate(n, G.link_parents(n))
    return r.select("investigation_id", "root_cause", "severity", "confidence", "findings", F.array_join("causal_chain", " > ").alias("causal_chain"), F.array_join("recommendations", "; ").alias("recommendations"))


_TITLES = {"timeout": "Timeout", "connection_error": "Connection Error", "data_error": "Data Error", "context_loss": "Context Loss", "error_trace": "Error Trace"}
_TITLE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TITLES.items()) + " END"
# findings with their text, id and place in the order of severity, confidence and id
_RANKED = f"""{_FOUND},
fs AS (SELECT fd.*, CASE WHEN agent = 'LogAnalysisAgent' THEN concat({_TITLE}, ' in ', function_name, ': ', error) ELSE concat('slow ', span_id) END AS summary FROM fd JOIN nodes_heap USING (span_id)),
fi AS (SELECT *, md5(concat_ws('|', investigation_id, agent, kind, summary, span_id)) AS finding_id FROM fs),
fo AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY rank DESC, confidence DESC, finding_id) AS turn FROM fi)"""
_texts = lambda texts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
_ADVISED = "CASE WHEN agent <> 'LogAnalysisAgent' THEN ['Profile it'] " + " ".join(f"WHEN kind = '{k}' THEN {_texts(a)}" for k, a in ADVICE.items()) + f" ELSE {_texts(OTHER_ADVICE)} END"


@query(f"""
WITH {_RANKED}, {_CONFLICT},
oc AS (SELECT investigation_id, round(avg(confidence) * CASE WHEN investigation_id IN (SELECT investigation_id FROM cf) THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS sure FROM fd GROUP BY 1)
SELECT investigation_id, concat('[', CASE rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END, '] ', summary, ' (', CASE WHEN sure >= 0.8 THEN 'confident' ELSE 'uncertain' END, ', ', round(sure * 100)::INT, '%)') AS diagnosis
FROM fo JOIN oc USING (investigation_id) WHERE turn = 1""")
def r08_quick_diagnosis(spark, d):
    return R.quick_diagnosis(R.rca_report(_found(spark, d), _nodes(spark, d)))


@query(f"""
WITH {_RANKED}, a AS (SELECT investigation_id, turn, unnest({_ADVISED}) AS r, unnest(range(0, len({_ADVISED}))) AS i FROM fo),
b AS (SELECT *, row_number() OVER (PARTITION BY investigation_id, r ORDER BY turn, i) AS no FROM a)
SELECT investigation_id, string_agg(r, '; ' ORDER BY turn, i) AS recommendations FROM b WHERE no = 1 GROUP BY 1""")
def w08_ranked_recommendations(spark, d):
    return R.ranked_recommendations(_found(spark, d)).select("investigation_id", F.array_join("recommendations", "; ").alias("recommendations"))


@query(f"""
WITH {_FOUND}, h AS (SELECT span_id, function_name, row_number() OVER (PARTITION BY function_name ORDER BY span_id) AS rank FROM nodes_heap)
SELECT fd.investigation_id, fd.span_id, fd.kind, CASE WHEN fd.agent = 'LogAnalysisAgent' THEN 1 ELSE 0 END + CASE WHEN h.rank <= 3 THEN 1 ELSE 0 END AS locations FROM fd JOIN h USING (span_id)""")
def r09_enrich_locations(spark, d):
    from pyspark.sql import Window

    n = _nodes(spark, d)
    hits = n.select("span_id", F.row_number().over(Window.partitionBy("function_name").orderBy("span_id")).alias("rank"), F.concat(F.lit("code:"), "span_id").alias("location"))
    return R.enrich_locations(_found(spark, d), hits).select("investigation_id", F.col("affected_spans")[0].alias("span_id"), F.col("finding_type").alias("kind"), F.size("source_locations").alias("locations"))


@query("SELECT 'connection_pool' AS fix_type, concat(source_file, ':', source_line) AS location, count(*) AS findings FROM nodes_heap WHERE error LIKE 'Connection%' GROUP BY ALL")
def r10_fix_candidates(spark, d):
    n = _nodes(spark, d)
    f = R.error_findings(n, G.link_parents(n)).withColumn("evidence", F.array_append("evidence", F.when(F.col("finding_type") == "connection_error", "httpx client").otherwise("")))
    return R.fix_candidates(f).groupBy("fix_type", "location").agg(F.count("*").alias("findings"))


@query("""
SELECT conv_id * 1000 + turn AS id, role AS root_cause, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN turn % 3 = 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, 2 AS items FROM conversations""")
def r11_parse_verdicts(spark, d):
    c = view(spark, d, "conversations")
    text = F.concat_ws("\n", F.lit("ROOT_CAUSE: first"), F.concat(F.lit("ROOT_CAUSE: "), "role"), F.concat(F.lit("SEVERITY: "), F.when(F.col("turn") % 2 == 0, "HIGH").otherwise("odd")), F.concat(F.lit("CONFIDENCE: "), F.when(F.col("turn") % 3 == 0, "high").otherwise("0.5")), F.lit("- one\n- two"))
    v = R.parse_llm_verdicts(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text")))
    return v.select("id", "root_cause", "severity", "confidence", F.size("recommendations").alias("items"))


@query("""
WITH RECURSIVE cl AS (SELECT span_id, span_id AS ancestor_id, 0 AS distance FROM nodes_heap WHERE error IS NOT NULL
  UNION ALL SELECT cl.span_id, n.parent_span_id, cl.distance + 1 FROM cl JOIN nodes_heap n ON n.span_id = cl.ancestor_id WHERE n.parent_span_id IS NOT NULL),
x AS (SELECT DISTINCT b.trace_id FROM cl JOIN nodes_heap a ON a.span_id = ancestor_id JOIN nodes_heap b ON b.span_id = cl.span_id WHERE distance > 0 AND a.error IS NOT NULL)
SELECT 'errors' AS kind, count(*) AS findings FROM nodes_heap WHERE error IS NOT NULL UNION ALL SELECT 'gaps', count(DISTINCT trace_id) FROM nodes_heap WHERE context_id IS NULL UNION ALL SELECT 'cascades', count(*) FROM x""")
def r13_error_agent(spark, d):
    n = _nodes(spark, d)
    f = R.error_agent_findings(n, G.link_parents(n))
    kind = F.when(F.col("finding_type") == "cascading_failure", "cascades").when(F.col("summary").startswith("Context lost"), "gaps").otherwise("errors")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("findings"))


# --- windows ----------------------------------------------------------------------------------------------------------


def _stream_spans(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("start_ts"), F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "failed").alias("error"))


_WINDOWS = """
WITH e AS (SELECT ts, value AS d, event_type = 'error' AS bad, unnest(range(6)) AS k FROM events),
w AS (SELECT date_trunc('hour', ts) - to_hours(k::INT) AS window_start, d, bad, row_number() OVER (PARTITION BY date_trunc('hour', ts) - to_hours(k::INT) ORDER BY d) AS rn, count(*) OVER (PARTITION BY date_trunc('hour', ts) - to_hours(k::INT)) AS n FROM e),
s AS (SELECT epoch_ms(window_start) AS window_ms, count(*) AS total, count(CASE WHEN bad THEN 1 END) AS errors, avg(d) AS a, max(CASE WHEN rn = least(n * 95 // 100 + 1, n) THEN d END) AS p, max(d) AS m FROM w GROUP BY 1),
t AS (SELECT *, errors / total AS r FROM s),
u AS (SELECT *, least(1.0, CASE WHEN r > 0.05 THEN least(0.4, r * 4) ELSE 0 END + CASE WHEN p > 100 THEN least(0.4, (p / 100 - 1) * 0.2) ELSE 0 END + CASE WHEN m > 5 * a THEN 0.2 ELSE 0 END) AS score FROM t)"""
_OPTIONS = {"time_col": "start_ts", "window": "6 hours", "slide": "1 hour"}


def _stats(df: DataFrame) -> DataFrame:
    return df.select(F.unix_millis("window_start").alias("window_ms"), "total", "errors", F.round("avg_ms", 9).alias("avg_ms"), "p95_ms", "max_ms", F.round("score", 6).alias("score"))


_STATS_SQL = _WINDOWS + " SELECT window_ms, total, errors, round(a, 9) AS avg_ms, p AS p95_ms, m AS max_ms, round(score, 6)::DOUBLE AS score FROM u"


@query(_STATS_SQL)
def t06_window_stats(spark, d):
    """T01, T02 over the static table."""
    return _stats(W.anomaly_score(W.sliding_window_stats(_stream_spans(view(spark, d, "events")), **_OPTIONS), lat_thr=100))


@query(_WINDOWS + " SELECT window_ms, round(score, 2)::DOUBLE AS score, total AS spans, round(r, 3) AS error_rate FROM u WHERE round(score, 9) >= 0.7")
def t03_alerts(spark, d):
    a = W.anomaly_alerts(_stream_spans(view(spark, d, "events")), lat_thr=100, **_OPTIONS)
    return a.select(F.unix_millis("window_start").alias("window_ms"), "score", "spans", "error_rate")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    schema = view(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event*.parquet")


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there, its last result written into a new shared folder."""
    spark, path = stream.sparkSession, G.shared_folder(stream.sparkSession, name)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    out.foreachBatch(lambda batch, i: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(_STATS_SQL)
def t01_stream_windows(spark, d):
    """T01, T02, I10 as a stream; complete mode gives all windows at the end."""
    return _stats(_drained(W.anomaly_score(W.sliding_window_stats(_stream_spans(_streamed(spark, d)), **_OPTIONS), lat_thr=100), "complete", "windows"))


_CLOSED = "epoch_ms((SELECT max(ts) FROM events) - INTERVAL 1 HOUR) >= window_ms + 6 * 3600000"


@query(f"{_STATS_SQL} WHERE {_CLOSED}")
def t01_pane_windows(spark, d):
    """T01 in append mode from panes of value counts: each window that the watermark has passed, once."""
    stream = _stream_spans(_streamed(spark, d)).withWatermark("start_ts", "1 hour")
    return _stats(_drained(W.anomaly_score(W.pane_stats(stream, **_OPTIONS).drop("closed"), lat_thr=100), "append", "panes"))


@query(_WINDOWS + f"""
SELECT window_ms, event_id FROM u JOIN (SELECT event_id, epoch_us(ts) AS us FROM events) v ON us >= window_ms * 1000 AND us < (window_ms + 6 * 3600000) * 1000
WHERE round(score, 9) >= 0.7 AND {_CLOSED}""")
def t04_alerting_spans(spark, d):
    """The spans of each alerting window, as the stream hands them to the investigation."""
    events = _streamed(spark, d)
    stream = events.select(F.col("ts").cast("timestamp").alias("start_ts"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "failed").alias("error"), "event_id").withWatermark("start_ts", "1 hour")
    found = W.alerting_spans(stream, lat_thr=100, **_OPTIONS)
    return _drained(found.select(F.unix_millis("window_start").alias("window_ms"), "event_id"), "append", "alerting")


@query("SELECT count(*) AS ingested, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, max(value) AS max_ms FROM events")
def t05_ingest_counters(spark, d):
    return _drained(W.ingest_counters(_stream_spans(_streamed(spark, d))), "complete", "counters")
