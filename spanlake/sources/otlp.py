"""OTLP JSON documents to flat spans and trace events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.schemas import OTLP, SPANS

# Names of the span kinds 0 to 5.
SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")


def _value(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _attributes(a: Column) -> Column:
    """A map of the attributes; of repeated keys the last one counts."""
    known = F.filter(F.coalesce(a, F.array().cast(_EMPTY)), lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(known, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _value(F.element_at(F.filter(known, lambda e: e["key"] == k), -1)["value"])))


_EMPTY = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"


def read_otlp_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Raw spans of the OTLP JSON documents in files, one for each line or each file."""
    return parse_otlp(spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "document"))


def parse_otlp(documents: DataFrame) -> DataFrame:
    """A row for each span of a `document` column: service, library, and the raw span as `span`."""
    parsed = documents.select(F.from_json("document", OTLP).alias("d"))
    resources = parsed.select(F.explode("d.resourceSpans").alias("r"))
    own = F.filter(F.col("r.resource.attributes"), lambda a: a["key"] == "service.name")
    scopes = resources.select(F.coalesce(_value(F.try_element_at(own, F.lit(1))["value"]), F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("s"))
    return scopes.select("service", F.coalesce("s.scope.name", F.lit("")).alias("library"), F.explode("s.spans").alias("span"))


def _valid() -> Column:
    number = lambda c: F.col(c).isNull() | F.col(c).try_cast("bigint").isNotNull()
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return named("span.traceId") & named("span.spanId") & number("span.startTimeUnixNano") & number("span.endTimeUnixNano")


def validate_spans(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans with both ids and whole-number times, and the others. An absent time is 0 and valid."""
    return raw.filter(_valid()), raw.filter(~_valid())


def normalize_spans(raw: DataFrame) -> DataFrame:
    """Flat spans: milliseconds, duration to 2 places, kind names, error text for status 2."""
    ns = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    start, end = ns("span.startTimeUnixNano"), ns("span.endTimeUnixNano")
    bad = F.coalesce(F.col("span.status.code") == 2, F.lit(False))
    kinds = F.array(*map(F.lit, SPAN_KINDS))
    event = lambda e: F.struct(e["name"].alias("name"), (e["timeUnixNano"].try_cast("bigint") / 1e6).alias("time_ms"), _attributes(e["attributes"]).alias("attributes"))
    return raw.select(
        F.col("span.traceId").alias("trace_id"),
        F.col("span.spanId").alias("span_id"),
        F.nullif(F.col("span.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.coalesce("span.name", F.lit("")).alias("name"),
        "service",
        "library",
        F.coalesce(F.get(kinds, F.coalesce("span.kind", F.lit(0))), F.lit("UNSPECIFIED")).alias("kind"),
        (start / 1e6).alias("start_time_ms"),
        (end / 1e6).alias("end_time_ms"),
        F.round((end - start) / 1e6, 2).alias("duration_ms"),
        F.when(bad, "ERROR").otherwise("OK").alias("status"),
        F.when(bad, F.coalesce(F.nullif(F.col("span.status.message"), F.lit("")), F.lit("unknown error"))).alias("error"),
        _attributes(F.col("span.attributes")).alias("attributes"),
        F.transform(F.coalesce("span.events", F.array().cast(f"array<struct<name:string,timeUnixNano:string,attributes:{_EMPTY}>>")), event).alias("events"),
    )


def spans_to_trace_events(spans: DataFrame, strict: bool = False) -> DataFrame:
    """An EXIT event for each span, and an ERROR event where it has an error (not if `strict`).

    Thread and depth are 0 and the context is the trace.
    """
    base = spans.select(
        F.col("name").alias("function_name"), F.col("service").alias("module"), F.coalesce(F.col("library") if "library" in spans.columns else F.lit(""), F.lit("")).alias("source_file"), F.lit(0).alias("source_line"),
        ((F.col("start_time_ms") + F.coalesce("duration_ms", F.lit(0.0))) / 1000).alias("timestamp"), (F.col("duration_ms") / 1000).alias("duration"), F.col("trace_id").alias("context_id"),
        "span_id", "parent_span_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("thread_id"), F.lit("main").alias("thread_name"), "error",
    )
    kinds = F.array(F.lit("EXIT")) if strict else F.array_compact(F.array(F.lit("EXIT"), F.when(F.col("error").isNotNull(), F.lit("ERROR"))))
    rows = base.withColumn("event_type", F.explode(kinds))
    return rows.withColumns({"duration": F.when(F.col("event_type") == "EXIT", F.col("duration")), "error": F.when(F.col("event_type") == "ERROR", F.col("error"))})


def read_span_stream(spark: SparkSession, path: str, time_col: str = "start_ts", delay: str = "1 minute", fmt: str = "parquet", schema: str = SPANS) -> DataFrame:
    """Spans as a stream of files, with a watermark on `time_col` (made of start_time_ms if absent)."""
    s = spark.readStream.schema(schema).format(fmt).load(path)
    if time_col not in s.columns:
        s = s.withColumn(time_col, F.timestamp_millis(F.col("start_time_ms").cast("bigint")))
    return s.withWatermark(time_col, delay)
