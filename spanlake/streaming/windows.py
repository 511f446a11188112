"""Sliding-window anomaly detection, and spans paired across micro-batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sliding_window_stats(spans: DataFrame, time_col: str = "start_ts", window: str = "60 seconds", slide: str = "5 seconds", approximate: bool = False) -> DataFrame:
    """window_start, window_end, total, errors, avg_ms, p95_ms, max_ms, error_rate.

    Takes a stream with a watermark on time_col, or a static table. The index-p95 comes from the
    window's sorted values; `approximate` replaces it by percentile_approx, whose state is bounded.
    """
    d = F.col("duration_ms")
    if approximate:
        p95 = F.percentile_approx(d, 0.95, 10_000)
    else:
        values = F.sort_array(F.collect_list(d))
        p95 = F.get(values, F.least(F.floor(F.size(values) * 95 / 100), F.size(values) - 1).cast("int"))
    out = spans.groupBy(F.window(time_col, window, slide).alias("w")).agg(F.count("*").alias("total"), F.count("error").alias("errors"), F.avg(d).alias("avg_ms"), p95.alias("p95_ms"), F.max(d).alias("max_ms"))
    return out.select("w.start", "w.end", "total", "errors", "avg_ms", "p95_ms", "max_ms", (F.col("errors") / F.col("total")).alias("error_rate")).withColumnsRenamed({"start": "window_start", "end": "window_end"})


def pane_stats(spans: DataFrame, time_col: str = "start_ts", window: str = "60 seconds", slide: str = "5 seconds", decimals: int | None = 2) -> DataFrame:
    """The columns of `sliding_window_stats` and `closed`, the window's event time, from counts of values in panes of one slide.

    A span is counted once, in its pane, by its duration rounded to `decimals` (as normalised spans are; None: not
    rounded); a window adds up the counts of its panes. So state grows with the different
    durations, not with the spans, and the index-p95 is that of all of them. Takes a static table, or a stream with
    a watermark on time_col in append mode: each window once, when the watermark passes its end.
    """
    value = F.col("duration_ms") if decimals is None else F.round("duration_ms", decimals)
    panes = spans.groupBy(F.window(time_col, slide).alias("pane"), value.alias("value")).agg(F.count("*").alias("n"), F.count("error").alias("errors"))
    inside = panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"))
    held = F.col("value").isNotNull()
    out = inside.agg(
        F.sum("n").alias("total"), F.sum("errors").alias("errors"), (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(held, F.col("n")))).alias("avg_ms"),
        F.sort_array(F.collect_list(F.when(held, F.struct("value", "n")))).alias("counts"), F.max("value").alias("max_ms"),
    )
    below = F.expr("aggregate(counts, 0L, (s, c) -> s + c.n) * 95 div 100")
    # the first value up to which more than `below` lie: as sorted[n * 95 // 100]
    step = F.expr("aggregate(counts, named_struct('left', below, 'p', cast(null as double)), (s, c) -> named_struct('left', s.left - c.n, 'p', if(s.left >= 0 and s.left < c.n, c.value, s.p)))")
    out = out.withColumn("below", below).withColumn("p95_ms", step["p"])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "errors", "avg_ms", "p95_ms", "max_ms", (F.col("errors") / F.col("total")).alias("error_rate"), F.window_time("w").alias("closed"))


def alerting_spans(spans: DataFrame, threshold: float = 0.7, err_thr: float = 0.05, lat_thr: float = 1000.0, time_col: str = "start_ts", window: str = "60 seconds", slide: str = "5 seconds", decimals: int | None = 2) -> DataFrame:
    """window_start and the columns of `spans`, for each window that alerts (see `anomaly_alerts`) and each span in it.

    As a stream, spans wait in state until the windows that they lie in have closed.
    """
    stats = pane_stats(spans, time_col, window, slide, decimals)
    alerts = anomaly_score(stats, err_thr, lat_thr).filter(F.round("score", 9) >= threshold)
    panes = F.sequence(F.col("window_start"), F.col("window_end") - F.expr(f"interval {slide}"), F.expr(f"interval {slide}"))
    alerts = alerts.select("window_start", "closed", F.explode(panes).alias("pane"))
    placed = spans.withColumn("pane", F.window(time_col, slide)["start"])
    in_time = (F.col("closed") >= F.col(time_col)) & (F.col("closed") <= F.col(time_col) + F.expr(f"interval {window}"))
    return placed.join(alerts.withColumnRenamed("pane", "at"), (F.col("pane") == F.col("at")) & in_time).select("window_start", *spans.columns)


def anomaly_score(stats: DataFrame, err_thr: float = 0.05, lat_thr: float = 1000.0) -> DataFrame:
    """Stats with `score`, 0 to 1: error rate up to 0.4, p95 up to 0.4, a maximum over 5 averages 0.2."""
    errors = F.when(F.col("error_rate") > err_thr, F.least(F.lit(0.4), F.col("error_rate") * 4)).otherwise(0.0)
    slow = F.when(F.col("p95_ms") > lat_thr, F.least(F.lit(0.4), (F.col("p95_ms") / lat_thr - 1) * 0.2)).otherwise(0.0)
    peak = F.when(F.col("max_ms") > 5 * F.col("avg_ms"), 0.2).otherwise(0.0)
    return stats.withColumn("score", F.least(F.lit(1.0), errors + slow + peak))


def anomaly_alerts(spans: DataFrame, threshold: float = 0.7, err_thr: float = 0.05, lat_thr: float = 1000.0, **window) -> DataFrame:
    """window_start, score, spans, error_rate, avg_ms, p95_ms, max_ms of the windows at or over the threshold."""
    scored = anomaly_score(sliding_window_stats(spans, **window), err_thr, lat_thr).filter(F.round("score", 9) >= threshold)
    return scored.select("window_start", F.round("score", 2).alias("score"), F.col("total").alias("spans"), F.round("error_rate", 3).alias("error_rate"), *(F.round(c, 1).alias(c) for c in ("avg_ms", "p95_ms", "max_ms")))


def start_alerts(spans: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Run callback(alerts, batch_id) on each micro-batch's alerts."""
    return anomaly_alerts(spans, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(callback).start()


def auto_rca(spans: DataFrame, report: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """When alerting windows close, sink(report(their spans)); the spans have the `window_start` that they lie in, once
    for each alerting window.

    `spans` is a stream with a watermark on time_col. A window is judged once, when the watermark passes its
    end, by all of its spans, however many micro-batches they came in; later ones are too late for it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            sink(report(batch), batch_id)
        batch.unpersist()

    return alerting_spans(spans, **options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def ingest_counters(spans: DataFrame) -> DataFrame:
    """Running totals; as a stream in complete mode."""
    return spans.groupBy().agg(F.count("*").alias("ingested"), F.count("error").alias("errors"), F.max("duration_ms").alias("max_ms"))


NODE = "span_id string, function_name string, context_id string, parent_span_id string, thread_id long, start_time double, end_time double, duration double, error string, closed boolean"


class _Pair(StatefulProcessor):
    """Holds a span's parts until its EXIT, or until its timer ends."""

    def __init__(self, timeout_ms: int, time_col: str):
        self.timeout_ms, self.time_col = timeout_ms, time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("span", NODE)

    def _row(self) -> dict:
        names = [c.split()[0] for c in NODE.split(", ")]
        return dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        span = self._row()
        span["span_id"], span["closed"] = key[0], False
        latest = max(timerValues.getCurrentWatermarkInMs(), 0)
        for pdf in rows:
            latest = max(latest, int(pdf[self.time_col].max().timestamp() * 1000))
            for e in pdf.sort_values(["timestamp", "event_type"]).to_dict("records"):
                e = {k: None if not isinstance(v, str) and pd.isna(v) else v for k, v in e.items()}
                if span["function_name"] is None or e["event_type"] == "ENTRY":
                    span |= {k: e[k] for k in ("function_name", "context_id", "parent_span_id", "thread_id")}
                if e["event_type"] == "ENTRY" and span["start_time"] is None:
                    span["start_time"] = e["timestamp"]
                elif e["event_type"] == "EXIT":
                    span |= {"end_time": e["timestamp"], "duration": e["duration"], "closed": True}
                elif e["event_type"] == "ERROR":
                    span["error"] = e["error"]
        if span["closed"]:
            self.state.clear()
            yield pd.DataFrame([span])
        else:
            fresh = not self.state.exists()
            self.state.update(tuple(span.values()))
            if fresh:
                self.handle.registerTimer(latest + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.state.exists():
            span = self._row()
            self.state.clear()
            yield pd.DataFrame([span])

    def close(self) -> None:
        pass


def stream_span_nodes(events: DataFrame, timeout_ms: int = 600_000, time_col: str = "ts") -> DataFrame:
    """Trace events (with a watermark on time_col) to nodes, as soon as a span's EXIT is there; spans that stay
    open are given out with closed = false once the watermark is timeout_ms past their first event.

    State is one row for each open span.
    """
    return events.groupBy("span_id").transformWithStateInPandas(_Pair(timeout_ms, time_col), NODE, "Append", "EventTime")
