"""Views over the given tables, as one SQL text for Spark and DuckDB.

`$ms(column)` is the column's milliseconds since 1970 in the engine's own words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

VIEWS: dict[str, str] = {
    # a trace for each order: the order is the root, its lines are the children
    "spans_star": """
SELECT concat('o', o_orderkey) AS trace_id, concat('o', o_orderkey) AS span_id, CAST(NULL AS STRING) AS parent_span_id,
  o_orderpriority AS name, c_mktsegment AS service, CAST($ms(o_orderdate) AS DOUBLE) AS start_time_ms,
  o_totalprice / 1000 AS duration_ms, CAST(NULL AS STRING) AS error, CAST(0 AS BIGINT) AS thread_id, concat('o', o_orderkey) AS context_id
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT concat('o', l_orderkey), concat('o', l_orderkey, '.', no), concat('o', l_orderkey), p_brand, n_name,
  CAST($ms(l_shipdate) AS DOUBLE), l_extendedprice / 1000,
  CASE WHEN l_returnflag = 'R' THEN CASE l_linenumber % 4 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'ConnectionError: refused' WHEN 2 THEN 'KeyError: id' ELSE 'Unexpected failure' END END,
  CAST(l_linenumber % 3 AS BIGINT), concat('o', l_orderkey)
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS no FROM lineitem) l
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # each user's events as a binary heap: a tree about six deep
    "spans_heap": """
SELECT concat('u', user_id) AS trace_id, concat('u', user_id, '.', n) AS span_id,
  CASE WHEN n > 1 THEN concat('u', user_id, '.', CAST(floor(n / 2) AS BIGINT)) END AS parent_span_id,
  event_type AS name, concat('svc', event_id % 3) AS service, CAST($ms(ts) AS DOUBLE) AS start_time_ms, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'ConnectionError: refused' WHEN 2 THEN 'KeyError: id' ELSE 'Unexpected failure' END END AS error,
  event_id % 4 AS thread_id, CASE WHEN event_id % 17 <> 0 THEN concat('u', user_id) END AS context_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e""",
    # the heap's spans as nodes of an execution forest; durations in seconds
    "nodes_heap": """
SELECT trace_id, span_id, parent_span_id, name AS function_name, service AS module, concat(service, '.py') AS source_file, CAST(10 + thread_id AS INT) AS source_line,
  start_time_ms / 1000 AS start_time, duration_ms / 1000 AS duration, error, thread_id, concat('t', thread_id) AS thread_name, context_id
FROM spans_heap""",
    # one analysis for each event type and day; latencies grow by a tenth each day
    "values_daily": """
SELECT event_type AS service, day, value * (1 + (day - first_day) / 10.0) AS v, event_type
FROM (SELECT event_type, value, CAST(floor($ms(ts) / 86400000) AS BIGINT) AS day, first_day FROM events CROSS JOIN (SELECT MIN(CAST(floor($ms(ts) / 86400000) AS BIGINT)) AS first_day FROM events) f) e""",
    "analyses_daily": """
SELECT concat(service, ':', day) AS id, service, day, COUNT(*) AS total_spans, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error_count,
  ROUND(AVG(v), 6) AS avg_latency_ms, ROUND(MAX(CASE WHEN rn = least(CAST(floor(n * 95 / 100) AS BIGINT) + 1, n) THEN v END), 6) AS p95_latency_ms, ROUND(MAX(v), 6) AS max_latency_ms
FROM (SELECT *, row_number() OVER (PARTITION BY service, day ORDER BY v) AS rn, COUNT(*) OVER (PARTITION BY service, day) AS n FROM values_daily) r
GROUP BY service, day""",
    # documents as code units
    "units_docs": """
SELECT doc_id AS unit_id, concat('f', doc_id) AS name, concat(source, '.', lang, '.f', doc_id) AS qualified_name,
  CASE doc_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS unit_type,
  concat(source, '/', lang, '/', doc_id % 50, '.py') AS source_file, CAST(doc_id % 400 AS INT) AS start_line, CAST(doc_id % 400 + floor(length(text) / 40) AS INT) AS end_line,
  concat('def f', doc_id, '(self, data, n=', doc_id % 7, ')') AS signature, '' AS docstring, text AS body_text,
  CASE WHEN doc_id % 10 = 0 THEN concat('GET /', lang, '/', source, '/', doc_id) END AS route_path
FROM documents""",
    # a call graph over the units: each calls the units of two smaller numbers, some also a larger one
    "edges_docs": """
SELECT DISTINCT a, b FROM (
  SELECT doc_id AS a, CAST(floor(doc_id / 2) AS BIGINT) AS b FROM documents WHERE doc_id > 0
  UNION ALL SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) FROM documents WHERE doc_id > 2
  UNION ALL SELECT doc_id, doc_id * 2 + 1 FROM documents WHERE doc_id % 97 = 5) e
WHERE a <> b AND b IN (SELECT doc_id FROM documents)""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def _text(sql: str, spark: bool) -> str:
    return re.sub(r"\$ms\(([a-z_]+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))" if spark else r"(epoch_us(\1) // 1000)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; nothing is registered in the catalog."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    inputs = {t: view(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
    sql = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(inputs) + r")\b", r"\1 {\2}", _text(sql, True))
    return spark.sql(sql, **inputs)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as leading CTEs."""
    found: list[str] = []

    def add(text: str) -> None:
        for v in _needs(text):
            if v not in found:
                add(VIEWS[v])
                found.append(v)

    add(sql)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in found)
    body = sql.strip()
    if ctes and body[:5].upper() == "WITH ":
        recursive = body[5:15].upper() == "RECURSIVE "
        return _text(f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{body[15 if recursive else 5:]}", False)
    return _text(f"WITH {ctes}\n{body}" if ctes else body, False)
