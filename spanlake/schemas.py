"""Column lists of the tables that the operators take and return."""

ATTRIBUTE = "struct<`key`:string,`value`:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>"

OTLP = f"""
resourceSpans array<struct<
  resource:struct<attributes:array<{ATTRIBUTE}>>,
  scopeSpans:array<struct<
    scope:struct<name:string>,
    spans:array<struct<
      traceId:string, spanId:string, parentSpanId:string, name:string, kind:int,
      startTimeUnixNano:string, endTimeUnixNano:string,
      status:struct<code:int,message:string>, attributes:array<{ATTRIBUTE}>,
      events:array<struct<name:string,timeUnixNano:string,attributes:array<{ATTRIBUTE}>>>>>>>>>
"""

SPANS = """
trace_id string, span_id string, parent_span_id string, name string, service string, library string, kind string,
start_time_ms double, end_time_ms double, duration_ms double, status string, error string,
attributes map<string,string>, events array<struct<name:string,time_ms:double,attributes:map<string,string>>>
"""

TRACE_EVENTS = """
event_type string, function_name string, module string, source_file string, source_line int, `timestamp` double,
duration double, context_id string, span_id string, parent_span_id string, depth int, thread_id bigint,
thread_name string, return_value string, error string, metadata map<string,string>
"""

CODE_UNITS = """
unit_id bigint, name string, qualified_name string, unit_type string, source_file string, start_line int, end_line int,
signature string, docstring string, body_text string, log_patterns array<string>, imports array<string>,
calls array<string>, tokens array<string>, route_path string
"""

FINDINGS = """
investigation_id string, finding_id string, agent_name string, finding_type string, severity string, summary string,
details string, evidence array<string>, affected_spans array<string>, confidence double,
recommendations array<string>, source_locations array<string>, metadata map<string,string>
"""

ANALYSES = """
id bigint, `timestamp` timestamp, service string, project string, severity string, confidence double, root_cause string,
summary string, llm_backend string, total_spans int, total_traces int, error_count int, avg_latency_ms double,
p95_latency_ms double, max_latency_ms double, report_path string, metadata string
"""

SPAN_STATS = "analysis_id bigint, span_name string, `count` bigint, avg_ms double, max_ms double, error_rate double"

ANALYSIS_FINDINGS = "analysis_id bigint, agent_name string, finding_type string, severity string, summary string, confidence double"

LOG_EVENTS = "`timestamp` bigint, message string, log_stream string, ingestion_time bigint"
