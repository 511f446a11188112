"""Search, correlation, code facts and streams on small hand-made tables."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import extract as X
from spanlake.functions.text import tokenize
from spanlake.operators import code as C
from spanlake.operators import correlate as K
from spanlake.operators import graph as G
from spanlake.operators import search as S
from spanlake.operators.contains import containing
from spanlake.plans.spans import _streamed
from spanlake.streaming import windows as W

PY = '''import os
from app.db import connect as c

class Client(Base):
    """Talks."""
    async def fetch(self, url, n=1):
        """Get it."""
        logger.info("fetching %s")
        return await get(url)

@app.get("/places/{id}")
def show(id):
    x = Client().fetch(id)
    def inner():
        pass
    return x

@bp.route("/p", methods=["POST"])
def make(): pass
%matplotlib
'''


def units_of(spark, *rows):
    """rows: (id, name, qualified, type, file, body, more)."""
    out = [(i, n, q, k, f, m.get("start", 1), m.get("end", 2), m.get("sig", f"def {n}()"), "", b, m.get("logs", []), [], m.get("calls", []), m.get("route")) for i, n, q, k, f, b, m in rows]
    schema = "unit_id long, name string, qualified_name string, unit_type string, source_file string, start_line int, end_line int, signature string, docstring string, body_text string, log_patterns array<string>, imports array<string>, calls array<string>, route_path string"
    return spark.createDataFrame(out, schema).withColumn("tokens", tokenize(F.concat_ws(" ", "name", "body_text")))


def fn(i, name, body="", file="a/b.py", kind="function", **more):
    return (i, name, more.pop("q", f"a.b.{name}"), kind, file, body, more)


def files(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "/").replace("_DOT_", "."), v) for k, v in contents.items()], "path string, content string")


# --- extraction -------------------------------------------------------------------------------------------------------


def test_python_units(spark):
    u = {r["name"]: r for r in C.extract_code_units(files(spark, app__main_DOT_py=PY, bad_DOT_py="def (")).collect()}
    assert set(u) == {"Client", "fetch", "show", "inner", "make"}
    assert (u["fetch"]["unit_type"], u["fetch"]["qualified_name"], u["fetch"]["docstring"]) == ("async_function", "app.main.Client.fetch", "Get it.")
    assert u["show"]["route_path"] == "GET /places/{id}" and u["make"]["route_path"] == "POST /p"
    assert sorted(u["show"]["calls"]) == ["Client", "fetch", "get"] and "app.db.connect" in u["show"]["imports"]
    assert u["fetch"]["log_patterns"] == ["fetching %s"] and u["Client"]["signature"] == "class Client(Base)"
    assert sorted((r["start_line"], r["unit_id"]) for r in u.values())[0] == (4, 0)


JS = """/** Says hi. */
export async function hello(name) { return greet(name); }
const add = (a, b) => a + b;
export class Box<T> extends Base {
  open(key: string): void { if (key) { this.turn(key); } }
}
interface Shape { x: number }
type Id = string;
enum Color { Red }
"""
GO = "// Run runs.\nfunc Run(a int) error {\n  return do(a)\n}\ntype S struct { x int }\nfunc (s *S) Get() int { return s.x }\n"
JAVA = "public class A {\n  /** Adds. */\n  public int add(int a, int b) { return sum(a, b); }\n}\n"


def test_brace_languages(spark):
    got = C.extract_code_units(files(spark, x_DOT_ts=JS, y_DOT_go=GO, Z_DOT_java=JAVA)).collect()
    kinds = {(r["source_file"], r["name"]): r["unit_type"] for r in got}
    assert kinds == {
        ("x.ts", "hello"): "function", ("x.ts", "add"): "function", ("x.ts", "Box"): "class", ("x.ts", "open"): "method", ("x.ts", "Shape"): "interface", ("x.ts", "Id"): "type_alias", ("x.ts", "Color"): "enum",
        ("y.go", "Run"): "function", ("y.go", "S"): "class", ("y.go", "Get"): "method", ("Z.java", "A"): "class", ("Z.java", "add"): "method",
    }
    by = {r["name"]: r for r in got if r["source_file"] != "x.ts" or r["name"] != "add"}
    assert by["open"]["qualified_name"] == "x.Box.open" and by["open"]["calls"] == ["turn"]
    assert by["hello"]["docstring"] == "Says hi." and by["Run"]["docstring"] == "Run runs." and by["add"]["calls"] == ["sum"]
    assert (by["Run"]["start_line"], by["Run"]["end_line"]) == (2, 4)


def test_own_extractor(spark):
    X.EXTRACTORS[".zz"] = lambda source, path, module: iter([X._unit(source.strip(), f"{module}.{source.strip()}", "function", 1, 1)])
    try:
        assert [r["qualified_name"] for r in C.extract_code_units(files(spark, q_DOT_zz="thing\n")).collect()] == ["q.thing"]
    finally:
        del X.EXTRACTORS[".zz"]


def test_sql_facts(spark):
    sql = "WITH c AS (SELECT a, COUNT(x, y) AS n FROM {{ ref('dim_a') }})\nSELECT t.id, SUM(v) total FROM c JOIN {{ source('raw', 'inv') }} s ON 1=1 JOIN shop.items i WHERE i.x > 1 GROUP BY t.id, 2 ORDER BY 1"
    r = C.sql_model_facts(files(spark, m_DOT_sql=sql, n_DOT_py="x")).first()
    assert (r["refs"], r["sources"], r["ctes"], r["tables"]) == (["dim_a"], ["raw.inv"], ["c"], ["shop.items"])
    assert (r["aggregates"], r["group_by"], r["filters"]) == (["COUNT", "SUM"], ["t.id", "2"], ["i.x > 1"])
    assert r["columns"] == ["a", "n", "id", "total"] and r["dependencies"] == ["dim_a", "raw.inv", "shop.items"]


def test_config_elements(spark):
    compose = "services:\n  db:\n    image: postgres:16\n    ports:\n      - '5432:5432'\n    environment:\n      - A=1\n  web:\n    image: nginx  # note\n"
    profile = "shop:\n  target: dev\n  outputs:\n    dev:\n      type: bigquery\n      password: x\n"
    env = "# c\nDB_HOST=h\nAPI_KEY='k'\nMODE=fast\nMODE=slow\n"
    soda = "data_source shop:\n  type: postgres\nsoda_cloud:\n  host: cloud\n  api_key_id: k\n"
    rows = C.config_elements(files(spark, s_DOT_yml=soda)).collect()
    assert [(r["element_type"], r["properties"]) for r in rows if r["name"] == "soda_cloud"] == [("credential", {"host": "cloud", "api_key_id": "k"})]
    toml = "top = 1\n[tool.x]\na = 'b'\n"
    got = {(r["name"], r["element_type"]): r["properties"] for r in C.config_elements(files(spark, c_DOT_yml=compose, p_DOT_yaml=profile, _DOT_env=env, t_DOT_toml=toml)).collect()}
    assert got[("db", "service")] == {"image": "postgres:16", "ports": "5432:5432", "A": "1"} and got[("web", "service")] == {"image": "nginx"}
    assert got[("shop.dev", "dbt_profile")] == {"type": "bigquery", "password": "x"}
    assert got[("env:connections", "connection")] == {"DB_HOST": "h"} and got[("env:credentials", "credential")] == {"API_KEY": "k"}
    assert got[("toml:root", "setting")] == {"top": "1"} and got[("toml:tool.x", "setting")] == {"a": "b"}


def test_router_prefixes(spark):
    main = "from api import routes\nfrom api.v1 import items\napp.include_router(routes.router, prefix='/api')\n"
    routes = "from api.v1 import items\nrouter.include_router(items.router, prefix='/items')\n"
    edges = C.router_edges(files(spark, main_DOT_py=main, api__routes_DOT_py=routes))
    u = units_of(spark, fn(1, "show", file="api/v1/items.py", route="GET /{id}"), fn(2, "root", file="api/routes.py", route="GET /"), fn(3, "plain", file="x.py", route="GET /x"))
    assert {r["name"]: r["route_path"] for r in C.resolve_router_prefixes(u, edges).collect()} == {"show": "GET /api/items/{id}", "root": "GET /api/", "plain": "GET /x"}


def test_route_declarations(spark):
    got = C.file_routes(files(spark, a_DOT_js="app.get('/p', show)", b_DOT_py="x"))
    assert [(r["handler"], r["route"]) for r in got.collect()] == [("show", "GET /p")]
    java = 'class A {\n  @GET\n  @Produces("x/y")\n  @Path("/items/{id}")\n  public Item find(int id) { }\n  @PostMapping("/new")\n  Item make() { }\n}'
    next_ = "import x from 'y'\nexport async function GET(req) {}\nexport function POST(req) {}\nfunction PUT() {}\n"
    got = C.file_routes(files(spark, A_DOT_java=java, route_DOT_ts=next_)).collect()
    assert {(r["handler"], r["route"]) for r in got} == {("find", "GET /items/{id}"), ("make", "POST /new"), ("GET", "GET /"), ("POST", "POST /")}


def test_function_expressions_and_generic_methods(spark):
    ts = "export const run = async function <T>(a, b) {\n  return a\n}\nclass Box {\n  map<U>(f) {\n    return f\n  }\n  async get(k): Promise<U> {\n  }\n}\n"
    got = {(r["name"], r["unit_type"]) for r in C.extract_code_units(files(spark, a_DOT_ts=ts)).collect()}
    assert got == {("run", "function"), ("Box", "class"), ("map", "method"), ("get", "method")}


# --- calls and rules --------------------------------------------------------------------------------------------------


def test_call_edges(spark):
    u = units_of(spark, fn(1, "run", calls=["help", "a.b.other", "far", "run", "nope"]), fn(2, "help"), fn(3, "help", file="z.py", q="z.help"), fn(4, "other"), fn(5, "far", file="y.py", q="y.far"), fn(6, "far", file="x.py", q="x.far"))
    assert {(r["caller"], r["callee"]) for r in C.call_edges(u).collect()} == {(1, 2), (1, 4), (1, 6)}
    assert {(r["a"], r["b"]) for r in C.call_edges_by_name(u).collect()} == {("run", "help"), ("run", "far")}


def test_structure(spark):
    u = units_of(
        spark, fn(1, "main", calls=["a"]), fn(2, "a", "x = big(1)", end=200), fn(3, "big", sig="def big(p, q, r=1, *s)"), fn(4, "unused"), fn(5, "_hidden"), fn(6, "route", route="GET /x"), fn(7, "helper", kind="method")
    )
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "caller long, callee long")
    issues = {(r["type"], r["severity"], r["subject"]) for r in C.structural_issues(u, edges).collect()}
    assert issues == {("dead_code", "info", "4"), ("circular_dependency", "warning", "2"), ("complexity", "info", "2"), ("arity_mismatch", "critical", "2")}
    assert {r["severity"]: r["count"] for r in C.issue_counts(C.structural_issues(u, edges)).collect()} == {"info": 2, "warning": 1, "critical": 1}
    assert [r["name"] for r in C.entry_points(u, edges).collect()] == ["route", "main", "_hidden", "helper", "unused"]
    names = spark.createDataFrame([("main", "a")], "a string, b string")
    assert C.unused_names(u, names, 3).first().asDict() == {"n": 4, "names": ["_hidden", "big", "helper", "unused"]}
    assert C.unused_names(u, names, 5).count() == 0
    assert {r["module"]: r["functions"] for r in C.instrumentation_targets(u).collect()} == {"a.b": ["a", "big", "helper", "route", "unused"]}
    assert C.route_inventory(u).first().asDict() == {"method": "GET", "path": "/x", "handler": "route", "location": "a/b.py:1"}


def test_coupling_and_fanout(spark):
    u = units_of(spark, *(fn(i, f"c{i}", file="x.py", calls=["t", "u"]) for i in range(9)), fn(20, "t", file="y.py"), fn(21, "u", file="y.py"))
    assert [tuple(r) for r in C.tight_coupling(u).collect()] == [("x.py", "y.py", 18)]
    e = spark.createDataFrame([("a", str(i)) for i in range(11)] + [("b", "1")], "a string, b string")
    assert [tuple(r) for r in C.high_fanout(e).collect()] == [("a", 11)]


def test_static_trace_feeds_the_graph(spark):
    u = units_of(spark, fn(1, "main"), fn(2, "a", "# TODO mend"), fn(3, "b"), fn(4, "c"))
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 2)], "caller long, callee long")
    n = G.build_span_nodes(C.static_trace(u, edges).select("event_type", "function_name", "module", "source_file", "source_line", "timestamp", "duration", "context_id", "span_id", "parent_span_id", "depth", "thread_id", "thread_name", "error"))
    rows = {r["function_name"]: r for r in n.collect()}
    assert set(rows) == {"main", "a", "b", "c"} and rows["a"]["error"].startswith("Code quality: TODO")
    assert rows["c"]["parent_span_id"] == rows["a"]["span_id"] and rows["main"]["parent_span_id"] is None
    assert rows["main"]["start_time"] < rows["a"]["start_time"] < rows["c"]["start_time"] < rows["b"]["start_time"] < rows["main"]["end_time"]


def test_rules(spark):
    u = units_of(
        spark,
        fn(1, "q", "db.execute(f'select {x}')", sig="def q(request: Req, n=1)"), fn(2, "r", "db.query(\"a %s\" % b)\nrequest", sig="def r(data)"), fn(3, "s", "password = 'hunter2hunter2'"),
        fn(4, "t", "# password = 'hunter2hunter2'"), fn(5, "u", "yaml.load(f)"), fn(6, "v", "yaml.load(f, Loader=L)"), fn(7, "w", "eval(data)", file="tests/w.py"), fn(8, "caller", "q(data)", sig="def caller(data)"),
    )
    got = {(r["unit_id"], r["family"]): r["confidence"] for r in C.pattern_findings(u).collect()}
    assert got == {(1, "sql_injection"): 0.85, (2, "sql_injection"): 0.85, (3, "hardcoded_secret"): 0.75, (5, "unsafe_deserialization"): 0.90}
    near = units_of(spark, fn(1, "q", "request = 1\ndb.execute(f'x')", sig="def q(request)"))
    assert C.pattern_findings(near).first()["confidence"] == 0.95
    assert [r["taint"] for r in u.filter("unit_id = 1").select(C.tainted_params(F.col("signature")).alias("taint")).collect()] == [["request"]]
    for match in ("token", "substring"):
        assert {(r["caller"], r["callee"]) for r in C.cross_function_taint(u, match).collect()} >= {(8, 1)}
    mine = spark.createDataFrame([("mine", "low", 0.1, 0, "hunter2")], C.rules_table(spark).schema)
    assert {r["family"] for r in C.pattern_findings(u, C.rules_table(spark, mine)).filter("unit_id = 3").collect()} == {"hardcoded_secret", "mine"}
    routes = units_of(spark, *(fn(i, f"h{i}", "pass", route=f"GET /{i}") for i in range(4)), fn(9, "ok", "@login_required", route="GET /z"), fn(10, "health", route="GET /health"))
    assert C.missing_auth(routes).first()["n"] == 4 and C.missing_auth(routes.filter("unit_id < 3")).count() == 0
    found = {(r["agent_name"], r["finding_type"]) for r in C.code_findings(u).collect()}
    assert {("SecurityAgent", "sql_injection"), ("SecurityAgent", "hardcoded_secret")} <= found


# --- search -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return units_of(
        spark,
        fn(1, "connect_database", "open the database connection pool", file="src/db/pool.py", logs=["Database connection failed"]),
        fn(2, "handle_http", "parse http request header", file="src/web/http.py", route="GET /api/users/{id}"),
        fn(3, "charge_card", "charge card payment gateway", file="src/pay/card.py", kind="method", route="POST /charge"),
        fn(4, "list_items", "select from products table", file="src/shop/items.py", q="shop.items.list_items"),
        fn(5, "other", "nothing here", file="src/x.py"),
    )


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_tfidf(spark, corpus):
    postings, df = S.build_tfidf(corpus)
    got = S.search_tfidf(asked(spark, "database database error"), postings, df, corpus.count(), 3).collect()
    assert [(r["unit_id"], r["matched_terms"]) for r in got] == [(1, ["database"])]
    assert got[0]["score"] == pytest.approx(2 * math.log(5 / 2), abs=1e-6)


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "unit_id long, vector array<double>")
    q = spark.createDataFrame([(7, [0.9, 0.1, 0.0])], "query_id long, vector array<double>")
    assert [(r["unit_id"], r["rank"]) for r in S.vector_top_k(q, v, 2).orderBy("rank").collect()] == [(0, 1), (1, 2)]
    assert [r["unit_id"] for r in S.vector_top_k(q, v, 3).collect()] == [0, 1]
    assert S.vector_top_k(q.limit(0), v).count() == 0


def test_log_patterns_and_fusion(spark, corpus):
    hits = S.search_log_pattern(asked(spark, "connection failed", "ERROR: database connection failed now", "nope"), corpus).collect()
    assert {(r["query_id"], r["unit_id"], r["score"]) for r in hits} == {(0, 1, 1.0), (1, 1, 0.5)} or {(r["query_id"], r["unit_id"]) for r in hits} == {(0, 1), (1, 1)}
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (0, "x", 3)], "query_id long, qualified_name string, rank int")
    b = spark.createDataFrame([(0, "y", 1)], a.schema)
    assert [(r["qualified_name"], r["score"]) for r in S.rrf_fuse([a, b]).orderBy("rank").collect()] == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61 + 1 / 63, 6))]


def test_lookups(spark, corpus):
    first = lambda df: {r["query_id"]: r["unit_id"] for r in df.filter("rank = 1").collect()}
    assert first(S.lookup_name(asked(spark, "items.list_items", "other", "ther"), corpus)) == {0: 4, 1: 5}
    assert first(S.lookup_route(asked(spark, "POST /charge", "GET /api/users/abc", "/charge", "GET /none"), corpus)) == {0: 3, 1: 2, 2: 3}
    assert first(S.lookup_route_fuzzy(asked(spark, "/api/users/42", "/x/42"), corpus)) == {0: 2}
    assert first(S.lookup_body(asked(spark, "PRODUCTS"), corpus)) == {0: 4}
    assert first(S.lookup_path(asked(spark, "WEB"), corpus)) == {0: 2} and first(S.lookup_file(asked(spark, "src/x.py"), corpus)) == {0: 5}
    words = spark.createDataFrame([(0, ["db", "charge", "gateway"]), (1, ["zzz"])], "query_id long, keywords array<string>")
    assert [(r["unit_id"], r["score"]) for r in S.lookup_keywords(words, corpus).collect()] == [(3, 4.0)]


def test_retrieval(spark, corpus):
    errors = spark.createDataFrame([(0, "connect_database", "database pool: down", "m")], "query_id long, function_name string, error string, module string")
    got = S.retrieve_for_error(errors, corpus).orderBy("rank").collect()
    assert got[0]["qualified_name"] == "a.b.connect_database" and len({r["qualified_name"] for r in got}) == len(got)
    named = asked(spark, "payment").withColumn("name", F.lit("other"))
    assert [(r["qualified_name"], r["rank"]) for r in S.retrieve(named, corpus).orderBy("rank").collect()] == [("a.b.other", 1), ("a.b.charge_card", 2)]
    assert S.retrieve_for_event(errors.drop("error"), corpus).count() > 0
    logs = S.retrieve_for_log(asked(spark, "connection failed", "payment gateway"), corpus)
    assert {(r["query_id"], r["qualified_name"]) for r in logs.collect()} == {(0, "a.b.connect_database"), (1, "a.b.charge_card")}
    text = S.context_window(logs, corpus).filter("query_id = 1").first()["context"]
    assert text.startswith("# a.b.charge_card (src/pay/card.py:1)\ndef charge_card()\n")


def test_svd(spark):
    docs = ["database connection error pool", "http request header parse", "database connection timeout", "http response body"]
    u = units_of(spark, *(fn(i, f"n{i}", d) for i, d in enumerate(docs))).withColumn("tokens", tokenize(F.col("body_text")))
    v = {r["unit_id"]: r["vector"] for r in S.svd_embeddings(u, 3).collect()}
    cos = lambda a, b: abs(sum(x * y for x, y in zip(v[a], v[b], strict=True)))
    assert cos(0, 2) > cos(0, 1) and all(math.isclose(sum(x * x for x in r), 1, rel_tol=1e-6) for r in v.values())


def test_singular_vectors_equal_numpy(spark):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((60, 45)) < 0.2, rng.random((60, 45)), 0) + np.outer(rng.random(60), rng.random(45))
    a[:, 44] = a[:, 43]  # rank 44
    rows = [(i, f"t{j}", float(a[i, j])) for i in range(60) for j in range(45) if a[i, j]]
    v, values = S.singular_vectors(spark.createDataFrame(rows, "unit_id long, token string, w double"), 6, rounds=25)
    want = np.linalg.svd(a)
    assert values == pytest.approx(want[1][:6], rel=1e-6)
    got = np.zeros((45, 6))
    for r in v.collect():
        got[int(r["token"][1:])] = r["v"]
    assert np.abs(got.T @ want[2][:6].T) == pytest.approx(np.eye(6), abs=1e-3)
    few, values = S.singular_vectors(spark.createDataFrame(rows[:3], "unit_id long, token string, w double"), 6)
    assert len(values) == 1 and few.count() == 3
    none, values = S.singular_vectors(spark.createDataFrame([], "unit_id long, token string, w double"), 6)
    assert len(values) == 0 and none.count() == 0


def test_containing_equals_contains(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé\n ") for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", "abc"]
    needles = [t[i : i + rng.randint(0, 9)] for t in texts if t for i in [rng.randrange(len(t))]] + ["zzz", "", None, "a", "ab", "a.c", "abc"]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")
    found = containing(n, t)
    got = [tuple(r) for r in found.collect()]
    want = {(x, y) for x in needles for y in texts if x is not None and y is not None and x in y}
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert containing(n.limit(0), t).count() == 0 and containing(n, t.limit(0)).count() == 0


def test_own_embedding(spark, corpus):
    """A pandas UDF makes the vectors."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float("database" in t), float("http" in t)])

    v = corpus.select("unit_id", embed("body_text").alias("vector"))
    q = asked(spark, "the database").select("query_id", embed("text").alias("vector"))
    assert [r["unit_id"] for r in S.vector_top_k(q, v).collect()] == [1]
    fused = S.hybrid_search(asked(spark, "the database"), corpus, embed=embed)
    assert fused.filter("rank = 1").collect() == S.hybrid_search(asked(spark, "the database"), corpus, v, q).filter("rank = 1").collect()


def test_cascade(spark, corpus):
    names = [
        ("code", {"code.function": "charge_card"}, "x", "code_attr"), ("POST /charge", {}, "x", "route"), ("sem", {"http.method": "post", "http.route": "/charge"}, "x", "http_semconv"),
        ("fuzzy", {"url.path": "/api/users/77"}, "x", "route_fuzzy"), ("svc.list items", {}, "x", "exact"), ("mongo.charge.zzz", {}, "x", "keyword_decomp"),
        ("dbq", {"db.statement": "SELECT * FROM products"}, "x", "db_pattern"), ("parse", {}, "x", "fuzzy"), ("zzz", {}, "x", None),
    ]
    rows = [(n, a, s, 1.0, str(i)) for i, (n, a, s, _) in enumerate(names)] + [("zzz", {"code.function": "other"}, "x", 2.0, "later")]
    spans = spark.createDataFrame(rows, "name string, attributes map<string,string>, service string, start_time_ms double, span_id string")
    found = K.correlate_spans(spans, corpus).cache()
    assert {r["name"]: r["match_type"] for r in found.collect()} == {n: k for n, _, _, k in names if k}
    labels = spark.createDataFrame([("code", "charge"), ("dbq", "items"), ("zzz", "any")], "name string, expected string")
    assert K.correlation_accuracy(found, labels, corpus).first().asDict() == {"total": 3, "hits": 2, "accuracy": 0.6667}


# --- streams ----------------------------------------------------------------------------------------------------------


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_anomaly_score(spark):
    s = spark.createDataFrame([(at(i / 10), 2000.0, "bad") for i in range(20)], "start_ts timestamp, duration_ms double, error string")
    alerts = W.anomaly_alerts(s, 0.5, 0.1, 500.0, window="5 seconds", slide="5 seconds").collect()
    assert [(r["score"], r["spans"], r["error_rate"], r["p95_ms"]) for r in alerts] == [(0.8, 20, 1.0, 2000.0)]
    assert W.anomaly_alerts(s.withColumn("error", F.lit(None).cast("string")), 0.5, 0.1, 5000.0).count() == 0
    assert W.sliding_window_stats(s, approximate=True).first()["p95_ms"] == 2000.0


def test_streams(spark, data, tmp_path):
    events = _streamed(spark, data)
    spans = events.select(F.col("ts").cast("timestamp").alias("start_ts"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "x").alias("error"))
    got = []
    options = {"lat_thr": 100.0, "window": "6 hours", "slide": "1 hour"}
    q = W.start_alerts(spans.withWatermark("start_ts", "1 day"), lambda df, i: got.extend(df.collect()), str(tmp_path / "a"), **options)
    q.processAllAvailable()
    q.stop()
    static = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("start_ts"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "x").alias("error"))
    want = W.anomaly_alerts(static, **options)
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()} and got


def test_windows_across_micro_batches(spark, tmp_path):
    """Alerts and their spans equal those of the static table on a stream cut into many batches, late rows included."""
    rng = random.Random(6)
    rows = [(at(rng.uniform(0, 400)), round(rng.expovariate(1 / 300), 2) if rng.random() < 0.95 else None, "bad" if 100 < i < 160 and rng.random() < 0.5 else None, i) for i in range(300)]
    rows.sort(key=lambda r: r[0] + dt.timedelta(seconds=rng.uniform(0, 25)))  # up to 25 seconds late
    rows.append((at(900), 1.0, None, 300))  # closes the windows of the others
    schema = "start_ts timestamp, duration_ms double, error string, id long"
    options = {"lat_thr": 700.0, "threshold": 0.4}
    static = spark.createDataFrame(rows, schema)
    stream, seen, reports = spark.readStream.schema(schema).parquet(str(tmp_path / "in")) if (tmp_path / "in").mkdir() is None else None, [], []
    stream = stream.withWatermark("start_ts", "30 seconds")
    q = W.auto_rca(stream, lambda df: df.groupBy("window_start").agg(F.sort_array(F.collect_list("id")).alias("ids")), lambda df, i: reports.extend((r["window_start"], r["ids"], i) for r in df.collect()), str(tmp_path / "a"), **options)
    stats = W.pane_stats(stream).drop("closed")
    q2 = stats.writeStream.option("checkpointLocation", str(tmp_path / "b")).foreachBatch(lambda df, i: seen.extend(df.collect())).start()
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        q2.processAllAvailable()
    q.stop()
    q2.stop()
    before = "window_end <= timestamp '2024-01-01 00:14:30'"
    show = lambda r: (r["window_start"], r["total"], r["errors"], r["avg_ms"] and round(r["avg_ms"], 6), r["p95_ms"], r["max_ms"])
    want = sorted(show(r) for r in W.sliding_window_stats(static).filter(before).collect())
    assert sorted(show(r) for r in seen) == want == sorted(show(r) for r in W.pane_stats(static).filter(before).collect())
    alerts = {r["window_start"] for r in W.anomaly_alerts(static, **options).collect()} - {r["window_start"] for r in W.sliding_window_stats(static).filter(f"not ({before})").collect()}
    assert 3 < len(alerts) < len(want) and len({i for _, _, i in reports}) > 1
    assert {w: ids for w, ids, _ in reports} == {w: sorted(r[3] for r in rows if w <= r[0] < w + dt.timedelta(seconds=60)) for w in alerts} and len(reports) == len(alerts)


def test_stream_of_span_events(spark, tmp_path):
    schema = "event_type string, function_name string, context_id string, span_id string, parent_span_id string, thread_id long, timestamp double, duration double, error string, ts timestamp"
    batches = [
        [("ENTRY", "f", "c", "1", None, 1, 0.0, None, None, at(0)), ("ENTRY", "g", "c", "2", "1", 1, 1.0, None, None, at(1))],
        [("ERROR", "f", "c", "1", None, 1, 2.0, None, "bad", at(2)), ("EXIT", "f", "c", "1", None, 1, 3.0, 3.0, None, at(3))],
        [("ENTRY", "h", "c", "3", None, 1, 5000.0, None, None, at(5000))],
        [("ENTRY", "i", "c", "4", None, 1, 9000.0, None, None, at(9000))],
    ]
    rows = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = None
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if stream is None:
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
            q = W.stream_span_nodes(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, i: rows.extend(df.collect())).start()
        q.processAllAvailable()
    q.stop()
    by = {r["span_id"]: r for r in rows}
    assert (by["1"]["closed"], by["1"]["duration"], by["1"]["error"], by["1"]["start_time"]) == (True, 3.0, "bad", 0.0)
    assert by["2"]["closed"] is False and by["2"]["start_time"] == 1.0 and "4" not in by


def test_units_are_numbered_over_ranges(spark):
    rng = random.Random(2)
    rows = list({(f"f{rng.randrange(40)}.py", rng.randrange(90), f"q{rng.randrange(3)}") for _ in range(800)})
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_file string, start_line int, qualified_name string").repartition(7)
    got = C.number_units(df)
    assert [tuple(r)[:3] for r in sorted(got.select("source_file", "start_line", "qualified_name", "unit_id").collect(), key=lambda r: r["unit_id"])] == sorted(rows)
    assert sorted(r["unit_id"] for r in got.collect()) == list(range(len(rows)))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert C.number_units(df.limit(0)).count() == 0


def test_vector_index(spark):
    """Clustered vectors: recall of 0.95 and more from a share of the lists; all lists give the exact search's rows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[100:700] = x[100]  # a hot vector
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(5000, None), (5001, [1.0, 2.0]), (5002, [3.0, 1.0])]
    asks = [(i, x[i].tolist()) for i in range(0, 3000, 40)] + [(9000, [1.0, 1.0]), (9001, None)]
    units, queries = spark.createDataFrame(rows, "unit_id long, vector array<double>"), spark.createDataFrame(asks, "query_id long, vector array<double>")
    index = S.build_vector_index(units, side=200)
    want = {tuple(r) for r in S.vector_top_k(queries, units).collect()}
    got = {tuple(r) for r in S.vector_top_k_indexed(queries, index).collect()}
    found = len({r[:2] for r in got} & {r[:2] for r in want})
    assert found >= 0.95 * len(want) and {r for r in got if r[0] == 9000} == {(9000, 5002, 4.0, 1), (9000, 5001, 3.0, 2)}
    assert {tuple(r) for r in S.vector_top_k_indexed(queries, index, lists=10**6, side=30).collect()} == want
    few = S.vector_top_k_indexed(queries, index, lists=3)
    assert few.filter("query_id = 0").count() == 10
    assert S.vector_top_k_indexed(queries.limit(0), index).count() == 0 and S.vector_top_k_indexed(queries, S.build_vector_index(units.limit(0))).count() == 0
