"""Sources, functions, graph, aggregates, topology, history and findings on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as X
from spanlake.functions.errors import assess_severity, classify_error
from spanlake.operators import aggregates as A
from spanlake.operators import findings as R
from spanlake.operators import cycles as Y
from spanlake.operators import graph as G
from spanlake.operators import history as H
from spanlake.operators import topology as T
from spanlake.sources import files as FS
from spanlake.sources import otlp as O

EVENTS = "event_type string, function_name string, module string, source_file string, source_line int, timestamp double, duration double, context_id string, span_id string, parent_span_id string, depth int, thread_id long, thread_name string, error string"
NODES = "trace_id string, span_id string, parent_span_id string, function_name string, module string, source_file string, source_line int, start_time double, duration double, error string, thread_id long, thread_name string, context_id string"


def ev(kind, name, span, parent=None, t=0.0, duration=None, thread=1, error=None, context="c"):
    return (kind, name, "m", "m.py", 1, t, duration, context, span, parent, 0, thread, f"t{thread}", error)


def node(span, parent=None, name=None, duration=None, error=None, thread=1, start=0.0, context="c", trace="t"):
    return (trace, span, parent, name or span, "m", "m.py", 7, start, duration, error, thread, f"t{thread}", context)


def nodes_of(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def ids(df, c="span_id"):
    return sorted(r[c] for r in df.collect())


# --- sources ----------------------------------------------------------------------------------------------------------


def otlp(*spans, service="shop"):
    attributes = [{"key": "service.name", "value": {"stringValue": service}}] if service else []
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": list(spans)}]}]})


def span(**more):
    return {"traceId": "t1", "spanId": "s1", "name": "op", "kind": 3, "startTimeUnixNano": "1000000000", "endTimeUnixNano": "1012345678"} | more


def test_otlp_spans(spark, tmp_path):
    docs = [
        otlp(span(attributes=[{"key": "a", "value": {"intValue": "5"}}, {"key": "a", "value": {"boolValue": True}}], status={"code": 2}, events=[{"name": "e", "timeUnixNano": "2000000", "attributes": []}])),
        otlp(span(spanId=""), span(spanId="s2", startTimeUnixNano="soon"), span(spanId="s3", status={"code": 2, "message": "bad"}, kind=None), service=None),
        otlp({"traceId": "t2", "spanId": "s4", "parentSpanId": ""}),
        "not json",
    ]
    (tmp_path / "in.json").write_text("\n".join(docs))
    raw = O.read_otlp_json(spark, str(tmp_path / "in.json"))
    good, bad = O.validate_spans(raw)
    assert (good.count(), bad.count()) == (3, 2)
    rows = {r["span_id"]: r for r in O.normalize_spans(good).collect()}
    s = rows["s1"]
    assert (s["service"], s["library"], s["kind"], s["duration_ms"], s["status"], s["error"]) == ("shop", "lib", "CLIENT", 12.35, "ERROR", "unknown error")
    assert s["attributes"] == {"a": "true"} and s["events"][0]["time_ms"] == 2.0
    assert (rows["s3"]["service"], rows["s3"]["error"], rows["s3"]["kind"]) == ("unknown", "bad", "UNSPECIFIED")
    assert (rows["s4"]["start_time_ms"], rows["s4"]["parent_span_id"], rows["s4"]["name"]) == (0.0, None, "")
    events = O.spans_to_trace_events(O.normalize_spans(good))
    assert sorted((r["span_id"], r["event_type"]) for r in events.collect()) == [("s1", "ERROR"), ("s1", "EXIT"), ("s3", "ERROR"), ("s3", "EXIT"), ("s4", "EXIT")]
    assert O.spans_to_trace_events(O.normalize_spans(good), strict=True).count() == 3
    n = {r["span_id"]: r for r in G.build_span_nodes(events).collect()}
    assert n["s1"]["error"] == "unknown error" and n["s1"]["duration"] == pytest.approx(0.01235)


def test_source_tree(spark, tmp_path):
    for p in ("a.py", "b/c.ts", "b/.env", "node_modules/x.js", "b/readme.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x = 1\n")
    got = FS.read_source_tree(spark, str(tmp_path)).collect()
    assert sorted(r["path"].split("/")[-1] for r in got) == ["a.py", "c.ts"]


def test_logs(spark):
    rows = [(1, " Failed to connect \n", "a", 1), (2, "fine", "a", 1), (3, None, "b", 1)]
    logs = spark.createDataFrame(rows, "timestamp long, message string, log_stream string, ingestion_time long")
    got = FS.classify_log_events(logs).orderBy("timestamp").collect()
    assert [r["level"] for r in got] == ["ERROR", "INFO", "INFO"] and got[0]["is_error"]
    assert [r["timestamp"] for r in FS.filter_log_events(logs, 1, 2, "fine").collect()] == [2]


def test_history_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("svc", 10, 100.0)], "service string, total_spans int, avg_latency_ms double").withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stats = a.select("service", "timestamp", F.lit("op").alias("span_name"), F.lit(3).cast("long").alias("count"))
    found = a.select("service", "timestamp", F.lit("x").alias("agent_name"))
    for _ in range(2):
        FS.write_analysis(a, stats, found, str(tmp_path / "h"))
    read = FS.read_history_tables(spark, str(tmp_path / "h"))
    assert [read[k].count() for k in ("analyses", "span_stats", "findings")] == [2, 2, 2]
    assert read["analyses"].join(read["span_stats"], F.col("id") == F.col("analysis_id")).count() == 4


def test_graph_files(spark, tmp_path):
    n = nodes_of(spark, node("a", duration=0.0123456), node("b", "a", error="x"))
    FS.write_graph(n, G.link_parents(n), str(tmp_path / "g"))
    rows = {r["id"]: r for r in spark.read.json(str(tmp_path / "g/nodes")).collect()}
    assert rows["a"]["duration_ms"] == 12.35 and rows["b"]["has_error"] and rows["a"]["source"] == "m.py:7"
    assert spark.read.json(str(tmp_path / "g/edges")).collect()[0]["edge_type"] == "call"


# --- functions --------------------------------------------------------------------------------------------------------


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "kind"), [("Request TIMED OUT on connection", "timeout"), ("Connection refused", "connection_error"), ("KeyError", "data_error"), ("lost context", "context_loss"), ("boom", "error_trace")])
def test_error_kinds(spark, text, kind):
    assert one(spark, classify_error(F.col("e")), e=text) == kind


def test_severity(spark):
    got = [one(spark, assess_severity(F.col("e"), F.lit(d)), e=e) for e, d in (("boom", 0), ("refused", 1), ("timeout", 1), ("boom", 1))]
    assert got == ["critical", "high", "high", "medium"]


def test_text_functions(spark):
    assert one(spark, X.tokenize(F.col("t")), t="def Foo_bar(self): return foo_bar + x1y + ab") == ["foo_bar", "foo_bar", "x1y"]
    assert one(spark, X.split_name(F.col("t")), t="getUserName.by-id_now") == ["get", "user", "name", "by", "id", "now"]
    assert one(spark, X.normalize_route(F.col("t")), t="/api/12/x/3") == "/api/{id}/x/{id}"
    assert one(spark, X.normalize_hex_route(F.col("t")), t="/a/0123456789abcdef01234567") == "/a/{id}"
    assert [one(spark, X.route_matches(F.col("p"), F.col("t")), p="/a/{x}/c", t=t) for t in ("/a/b/c/", "/a/b", "/a/b/d", "")] == [True, False, False, False]
    assert [one(spark, X.extract_sql_table(F.col("t")), t=t) for t in ("select 1 from `users` join b", "UPDATE a SET", "commit")] == ["users", "a", None]
    body = 'log.info("got it")\nprint(f\'done\')\nlogger.error("got it")'
    assert one(spark, X.extract_log_patterns(F.col("t")), t=body) == ["got it", "done"]
    assert one(spark, X.extract_calls(F.col("t"), F.col("n"), "javascript"), t="if (a) { foo(x.bar(1)); new Baz(); me() }", n="me") == ["foo", "bar", "Baz"]
    assert one(spark, X.extract_imports(F.col("t"), "go"), t='import (\n "fmt"\n "os"\n)\nimport "net"') == ["fmt", "os", "net"]
    assert one(spark, X.extract_imports(F.col("t"), "java"), t="import a.b.C;\nclass X {}") == ["a.b.C"]
    routes = one(spark, X.extract_routes(F.col("t"), "python"), t='@app.get("/p/{id}")\n@other\nasync def show(x):\n  pass\n@bp.route("/q")\ndef q(): pass')
    assert [(r["handler"], r["route"]) for r in routes] == [("show", "GET /p/{id}"), ("q", "GET /q")]
    routes = one(spark, X.extract_routes(F.col("t"), "go"), t='r.GET("/a", getA)\nhttp.HandleFunc("/h", handle)')
    assert sorted((r["handler"], r["route"]) for r in routes) == [("getA", "GET /a"), ("handle", "ANY /h")]
    code = '# note\nx = 1\n"""doc\nmore\n"""\n  // c\ny = 2\n\'\'\'one\'\'\'\nz'
    assert one(spark, X.strip_comments(F.col("t")), t=code) == "x = 1\ny = 2\nz"
    assert one(spark, X.match_context(F.col("t"), r"eval\("), t="a\n   eval(x)  \nb") == "eval(x)"
    assert [one(spark, X.redact_secret(F.col("t")), t=t) for t in ("short", "x" * 20)] == ["short", "x" * 15 + "..."]
    assert [one(spark, X.detect_static_error(F.col("t"), F.col("r")), t=t, r=r) for t, r in (("a\n # TODO: mend\nb", None), ("try:\nexcept :\n", None), ("print(1)", "GET /"), ("print(1)", None))] == [
        "Code quality: TODO: mend", "Anti-pattern: bare except clause (swallows all exceptions)", "Debug artifact: logging in production route handler", None,
    ]
    assert tuple(one(spark, X.parse_location(F.col("t")), t="a/b.py:12")) == ("a/b.py", 12)
    assert tuple(one(spark, X.parse_location(F.col("t")), t="a/b.py")) == ("a/b.py", None)


def test_traceparent(spark):
    head = "00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01"
    assert tuple(one(spark, X.parse_traceparent(F.col("t")), t=head)) == ("0af76519-16cd-43dd-8448-eb211c80319c", "b7ad6b7169203331")
    assert one(spark, X.parse_traceparent(F.col("t")), t="00-x") is None
    assert one(spark, X.format_traceparent(F.col("c"), F.col("s")), c="0af76519-16cd-43dd-8448-eb211c80319c", s="b7") == "00-0af7651916cd43dd8448eb211c80319c-b700000000000000-01"


def test_source_labels_and_language(spark):
    spans = spark.createDataFrame([({"db.statement": "s" * 80},), ({"http.url": "u", "http.route": "/r"},), ({},)], "attributes map<string,string>")
    assert [r["label"] for r in X.span_source_locations(spans).collect()] == ["db: " + "s" * 60, "http: u", "route: /r"]
    units = spark.createDataFrame([("a.go",), ("b.go",), ("c.py",), ("d.txt",)], "source_file string")
    assert X.primary_language(units).first()["language"] == "go"
    assert X.primary_language(units.limit(0)).first()["language"] == "python"


# --- graph ------------------------------------------------------------------------------------------------------------


def test_nodes_from_events(spark):
    rows = [ev("EXIT", "a", "1", t=2.0, duration=2.0), ev("ENTRY", "a", "1", t=0.0), ev("ENTRY", "b", "2", "1", t=0.5), ev("ERROR", "b", "2", "1", t=1.0, error="x"), ev("ERROR", "c", "3", "2", error="y", context=None), ev("ENTRY", "d", "4", "9")]
    n = {r["span_id"]: r for r in G.build_span_nodes(spark.createDataFrame(rows, EVENTS)).collect()}
    assert (n["1"]["start_time"], n["1"]["end_time"], n["1"]["duration"]) == (0.0, 2.0, 2.0)
    assert (n["2"]["duration"], n["2"]["end_time"], n["2"]["error"]) == (None, None, "x")
    assert n["3"]["has_context"] is False and n["4"]["end_time"] is None
    assert G.build_span_nodes(spark.createDataFrame([], EVENTS)).count() == 0


def test_edges_roots_leaves(spark):
    n = nodes_of(spark, node("a"), node("b", "a"), node("c", "a", thread=2), node("d", "gone"))
    e = G.link_parents(n)
    assert {(r["parent_id"], r["child_id"], r["edge_type"]) for r in e.collect()} == {("a", "b", "call"), ("a", "c", "cross_thread")}
    assert ids(G.find_roots(n, e)) == ids(G.orphan_or_root(n)) == ["a", "d"]
    assert ids(G.find_leaves(n, e)) == ["b", "c", "d"] and ids(G.branching_points(e)) == ["a"]
    assert ids(G.convergence_points(e.union(spark.createDataFrame([("d", "b", "link")], e.schema)))) == ["b"]
    assert tuple(G.graph_summary(n, e).first()) == (4, 1, 2, 1, 1, 0, 0)
    inside, kept = G.context_subgraph(nodes_of(spark, node("a"), node("b", "a", context="x")), e, "c")
    assert ids(inside) == ["a"] and kept.count() == 0


@pytest.mark.parametrize("seeded", [False, True])
def test_closure_of_random_forests(spark, seeded):
    rng = random.Random(8)
    parent = {i: rng.choice([None, *range(max(0, i - 4), i)]) if i else None for i in range(120)}
    n = nodes_of(spark, *(node(str(i), None if p is None else str(p)) for i, p in parent.items()))
    want = set()
    for i in parent:
        at, k = i, 0
        while at is not None:
            want.add((str(i), str(at), k))
            at, k = parent[at], k + 1
    seeds = [str(i) for i in range(0, 120, 7)]
    got = G.ancestor_closure(n, spark.createDataFrame([(s,) for s in seeds], "span_id string") if seeded else None)
    assert {tuple(r) for r in got.collect()} == ({w for w in want if w[0] in seeds} if seeded else want)


def test_closure_ends_on_a_cycle(spark):
    n = nodes_of(spark, node("a", "c"), node("b", "a"), node("c", "b"), node("d", "d"))
    assert {(r["span_id"], r["ancestor_id"]) for r in G.ancestor_closure(n).collect()} >= {("a", "c"), ("a", "a"), ("d", "d")}


def test_chains_and_paths(spark):
    n = nodes_of(spark, node("a", duration=0.05), node("b", "a", duration=0.03), node("c", "b", duration=0.01), node("d", "a", duration=0.04, start=1.0), node("e", "a"))
    cl = G.ancestor_closure(n)
    chains = {r["span_id"]: r["chain"] for r in G.causal_chain(n, cl).collect()}
    assert chains["c"] == ["a", "b", "c"] and "zz" not in chains
    best = G.critical_path(n, cl).first()
    assert (best["root_id"], best["leaf_id"], best["total"], best["path"]) == ("a", "c", 0.09, ["a", "b", "c"])
    order = [r["span_id"] for r in G.render_depth(n, cl).orderBy("sort_path").collect()]
    assert order == ["a", "b", "c", "e", "d"]


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 6), (4, 5), (7, 7)], "a long, b long")
    assert {(tuple(r["members"]), r["length"]) for r in G.find_cycles(e).collect()} == {((1, 2, 3), 3), ((3, 4), 2)}
    assert not G.is_dag(e) and G.is_dag(e.filter("a < b"))
    line = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 3)], "a long, b long")
    assert ids(Y.deep_call_chains(line, 4), "start") == [0, 1]


# --- aggregates -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40, 5000])
def test_index_p95_and_upper_median(spark, n):
    values = random.Random(n).sample(range(10 * n), n)
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None), (None, 3.0)], "k string, v double")
    s = sorted(values)
    got = {r["k"]: r["p95_ms"] for r in A.index_p95(df, ["k"], "v").collect()}
    assert got == {"k": s[min(n * 95 // 100, n - 1)], None: 3.0}
    assert A.upper_median(df.filter("k = 'k'"), [], "v").first()["median"] == s[n // 2]


def test_latency_summary_and_overview(spark):
    rows = [("t1", "a", "op", "x", 10.0, None, 1.0), ("t1", "b", "op", "x", 0.0, "bad", 2.0), ("t2", "c", "op2", "unknown", None, "worse", 3.0)]
    s = spark.createDataFrame(rows, "trace_id string, span_id string, name string, service string, duration_ms double, error string, start_time_ms double")
    r = A.latency_summary(s).first()
    assert (r["total_spans"], r["total_traces"], r["error_count"], r["avg_ms"], r["p95_ms"]) == (3, 2, 2, 5.0, 10.0)
    assert A.latency_summary(s, exclude_zero=True).first()["avg_ms"] == 10.0
    assert A.latency_summary(s, approximate=True).first()["p95_ms"] == 10.0
    o = A.telemetry_overview(s).first()
    assert (o["services"], o["avg_ms"], o["errors"]) == (1, 10.0, 2)
    out = {r["name"]: (r["outcome"], r["last_error"]) for r in A.operation_outcomes(s).collect()}
    assert out == {"op": ("failed", "bad"), "op2": ("failed", "worse")}
    assert {r["label"] for r in A.error_histogram(s).collect()} == {"bad (x1)", "worse (x1)"}
    assert {r["name"]: r["error_rate"] for r in A.span_stats(s).collect()} == {"op": 0.5, "op2": 1.0}


def test_outliers_need_six_peers(spark):
    five = nodes_of(spark, *(node(f"s{i}", name="f", duration=0.01) for i in range(4)), node("slow", name="f", duration=5.0))
    assert A.statistical_outliers(five).count() == 0
    six = five.union(nodes_of(spark, node("s9", name="f", duration=0.01), node("z", name="f", duration=0.0), node("n", name="f")))
    assert ids(A.statistical_outliers(six)) == ["slow"]
    assert ids(A.statistical_outliers(nodes_of(spark, node("x", name="g", duration=0.5), node("y", name="h", duration=0.001)))) == ["x"]


def test_self_time_bimodal_slowest(spark):
    n = nodes_of(spark, node("p", duration=1.0), node("c", "p", duration=0.9), node("q", duration=0.2), node("d", "q", duration=0.05), node("e", "q", name="e"))
    assert ids(A.self_time(n)) == ["c", "q"]
    m = nodes_of(spark, *(node(f"f{i}", name="f", duration=d) for i, d in enumerate((0.01, 0.01, 0.011, 0.2))), *(node(f"g{i}", name="g", duration=0.1) for i in range(4)))
    r = A.bimodal_operations(m).collect()
    assert [(x["function_name"], x["median_ms"], x["fast"], x["slow"]) for x in r] == [("f", 11.0, 3, 1)]
    assert [x["span_id"] for x in A.slowest_spans(n, 2).collect()] == ["p", "c"]


def test_trace_summary(spark):
    s = spark.createDataFrame([("t", "a", None, 5.0, None), ("t", "b", "a", 9.0, "x"), ("t", "c", "gone", 7.0, None)], "trace_id string, span_id string, parent_span_id string, duration_ms double, error string")
    assert tuple(A.trace_summary(s).first()) == ("t", 3, "ERROR", 7.0)


# --- topology, history ------------------------------------------------------------------------------------------------


def test_topology(spark):
    rows = [("in", "gateway", 200.0, "1", None, None), ("get", "user-service", 50.0, "2", "1", "x"), ("read", "cache", 5.0, "3", "2", None), ("get2", "user-service", 40.0, "4", "2", None), ("lone", None, 1.0, "5", None, None)]
    s = spark.createDataFrame(rows, "name string, service_name string, duration_ms double, span_id string, parent_span_id string, error string")
    n, e = T.service_topology(s)
    got = {r["service"]: r for r in n.collect()}
    assert set(got) == {"gateway", "user-service", "cache", "unknown"} and got["user-service"]["endpoints"] == ["get", "get2"] and got["user-service"]["avg_ms"] == 45.0
    assert {(r["source"], r["target"], r["call_count"], r["error_count"], r["avg_ms"]) for r in e.collect()} == {("gateway", "user-service", 1, 1, 50.0), ("user-service", "cache", 1, 0, 5.0)}
    assert T.topology_summary(n, e).first().asDict() == {"services": 4, "total_spans": 5, "dependencies": 2}


def test_regressions(spark):
    rows = [(1, "a", 1, 100.0, 200.0, 300.0), (2, "a", 2, 500.0, 900.0, 1500.0), (3, "b", 1, 1.0, 1.0, 1.0), (4, "c", 1, 0.0, 1.0, 1.0), (5, "c", 2, 9.0, 1.0, None)]
    a = spark.createDataFrame(rows, "id long, service string, timestamp long, avg_latency_ms double, p95_latency_ms double, max_latency_ms double")
    got = {(r["service"], r["metric"]): r["change"] for r in H.detect_regressions(a).collect()}
    assert got == {("a", "avg_latency_ms"): "+400%", ("a", "p95_latency_ms"): "+350%", ("a", "max_latency_ms"): "+400%"}
    assert H.detect_regressions(a, since=2).count() == 0
    stats = spark.createDataFrame([(1, "op", 10.0), (2, "op", 16.0), (1, "ok", 10.0), (2, "ok", 15.0)], "analysis_id long, span_name string, avg_ms double")
    assert [(r["span_name"], r["change"]) for r in H.detect_span_regressions(a, stats).collect()] == [("op", "+60%")]
    found = spark.createDataFrame([(2, "x", "t", "low", "s", 0.5)], "analysis_id long, agent_name string, finding_type string, severity string, summary string, confidence double")
    h = H.history_with_findings(a, found, "a", 5).orderBy("id").collect()
    assert [r["findings"] and len(r["findings"]) for r in h] == [None, 1]
    assert [r["avg_ms"] for r in H.span_trends(a, stats, "a", "op", 1).collect()] == [16.0]
    assert tuple(H.history_stats(a, found).first()) == (5, 3, 1) and [r[0] for r in H.list_services(a).collect()] == ["a", "b", "c"]
    s = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "session_id string, updated_at long, v string")
    assert {r["v"] for r in H.latest_session(s).collect()} == {"new", "only"}


# --- findings ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def request_nodes(spark):
    return nodes_of(
        spark,
        node("r", name="handle_request", error="ConnectionError: upstream", duration=0.5),
        node("d", "r", name="query_database", error="ConnectionError: refused", duration=0.2, start=1.0),
        node("n", "r", name="send_notification", thread=2, duration=0.01, start=2.0),
        node("l", "r", name="lost_fn", context=None, duration=0.01, start=3.0),
    )


def test_findings_of_a_failing_request(spark, request_nodes):
    e = G.link_parents(request_nodes)
    got = R.error_agent_findings(request_nodes, e).collect()
    errors = {f["affected_spans"][0]: f for f in got if f["finding_type"] == "connection_error"}
    assert (errors["r"]["severity"], errors["d"]["severity"], errors["d"]["confidence"]) == ("critical", "high", 0.85)
    assert errors["d"]["source_locations"] == ["m.py:7"] and "handle_request > query_database" in errors["d"]["details"]
    kinds = sorted(f["finding_type"] for f in got)
    assert kinds == ["cascading_failure", "connection_error", "connection_error", "context_loss"]
    assert G.find_cross_thread_edges(e).count() == 1


def test_report(spark, request_nodes):
    report = R.investigate(request_nodes, G.link_parents(request_nodes)).filter("investigation_id = 't'").first()
    assert report["severity"] == "critical" and "handle_request" in report["root_cause"]
    assert report["causal_chain"] == ["handle_request failed: ConnectionError: upstream"]
    assert len(report["recommendations"]) == len(set(report["recommendations"])) > 3


def finding(i, agent, kind, severity, spans, confidence, inv="t"):
    return (inv, i, agent, kind, severity, f"{kind} {i}", "", ["httpx used"], spans, confidence, [f"do {kind}", "always"], ["f.py:1"], {})


def test_primary_conflicts_confidence(spark):
    from spanlake.schemas import FINDINGS

    f = spark.createDataFrame([finding("1", "A", "x", "high", ["s"], 0.5), finding("2", "B", "y", "high", ["s", "u"], 0.5), finding("3", "A", "z", "low", ["u"], 0.9), finding("4", "A", "z", "low", [], 0.9, "w")], FINDINGS)
    assert {r["investigation_id"]: r["finding_id"] for r in R.primary_finding(f).collect()} == {"t": "1", "w": "4"}
    c = R.conflicting_findings(f)
    assert {(r["finding_id_a"], r["finding_id_b"]) for r in c.collect()} == {("1", "2"), ("2", "3")}
    everyone = spark.createDataFrame([("t",), ("w",), ("none",)], "investigation_id string")
    got = {r["investigation_id"]: r["confidence"] for r in R.overall_confidence(f, c, everyone).collect()}
    assert got == {"t": pytest.approx(1.9 / 3 * 0.8, abs=1e-6), "w": 0.9, "none": 1.0}
    assert {r["investigation_id"]: r["recommendations"] for r in R.ranked_recommendations(f).collect()}["t"] == ["do x", "always", "do y", "do z"]
    hits = spark.createDataFrame([("s", 1, "a.py:1"), ("s", 4, "b.py:1")], "span_id string, rank int, location string")
    assert {r["finding_id"]: r["source_locations"] for r in R.enrich_locations(f, hits).collect()}["1"] == ["f.py:1", "a.py:1"]
    assert {(r["finding_id"], r["fix_type"]) for r in R.fix_candidates(f).collect()} == {(i, "connection_pool") for i in "1234"}
    report = R.rca_report(f, nodes_of(spark, node("s"), node("u")), everyone)
    assert {r["investigation_id"]: r["root_cause"] for r in report.collect()}["none"] == "No issues detected"
    assert "[HIGH] x 1 (uncertain, 51%)" in {r["diagnosis"] for r in R.quick_diagnosis(report).collect()}


def test_verdicts(spark):
    text = "ROOT_CAUSE: a\nROOT_CAUSE: pool is full\nSEVERITY: High\nCONFIDENCE: 0.7\nEXPLANATION: so\n- one\n- two\n[NEED_CODE: f] [NEED_CODE: g] [NEED_CODE: h]"
    rows = R.parse_llm_verdicts(spark.createDataFrame([(1, text), (2, "CONFIDENCE: sure"), (3, None)], "id long, text string")).orderBy("id").collect()
    assert rows[0].asDict() == {"id": 1, "root_cause": "pool is full", "severity": "high", "confidence": 0.7, "explanation": "so", "recommendations": ["one", "two"], "code_requests": ["f", "g"]}
    assert (rows[1]["severity"], rows[1]["confidence"], rows[2]["root_cause"]) == ("medium", 0.85, None)


def test_own_detectors(spark, request_nodes):
    R.DETECTORS["mine"] = lambda nodes, edges: R.context_loss_finding(nodes).withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit(1.0))
    try:
        report = R.investigate(request_nodes, G.link_parents(request_nodes)).filter("investigation_id = 't'").first()
        assert report["root_cause"] == "Context lost at 1 point(s)"
    finally:
        del R.DETECTORS["mine"]
