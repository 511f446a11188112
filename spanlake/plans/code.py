"""Queries over documents as code units, routes, search and code facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text as X
from spanlake.operators import aggregates as A
from spanlake.operators import code as C
from spanlake.operators import correlate as K
from spanlake.operators import cycles as Y
from spanlake.operators import graph as G
from spanlake.operators import search as S
from spanlake.plans.spans import query
from spanlake.plans.views import view


def _units(spark, d) -> DataFrame:
    """units_docs with tokens, log patterns, calls and imports."""
    u = view(spark, d, "units_docs")
    n = F.lit("f")
    calls = F.array(F.concat(n, F.floor(F.col("unit_id") / 2).cast("string")), F.concat(n, F.floor(F.col("unit_id") / 3).cast("string")), F.lit("len"))
    return u.withColumns({"tokens": X.tokenize(F.col("body_text")), "log_patterns": F.when(F.col("unit_id") % 4 == 0, F.array(F.substring("body_text", 1, 12))).otherwise(F.array().cast("array<string>")), "calls": calls, "imports": F.array().cast("array<string>")})


_STOP = "', '".join(X.STOP_WORDS)
_TOK = f"tok AS (SELECT unit_id, t AS token FROM (SELECT unit_id, unnest(regexp_extract_all(lower(body_text), '[a-z_][a-z0-9_]*')) AS t FROM units_docs) x WHERE length(t) > 2 AND t NOT IN ('{_STOP}'))"


@query(f"WITH {_TOK} SELECT unit_id, count(*) AS tokens, min(token) AS first, max(token) AS last FROM tok GROUP BY 1")
def f04_tokenize(spark, d):
    t = view(spark, d, "units_docs").select("unit_id", X.tokenize(F.col("body_text")).alias("t")).filter("size(t) > 0")
    return t.select("unit_id", F.size("t").cast("bigint").alias("tokens"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


@query("SELECT unit_id, replace(lower(qualified_name), '.', '|') AS parts FROM units_docs")
def f05_split_name(spark, d):
    return view(spark, d, "units_docs").select("unit_id", F.array_join(X.split_name(F.col("qualified_name")), "|").alias("parts"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"


@query(f"SELECT page_id, regexp_replace({_PATH}, '/[0-9]+', '/{{id}}', 'g') AS route, regexp_replace({_PATH}, '/[0-9a-f]{{24}}', '/{{id}}', 'g') AS hex_route FROM pages")
def f06_normalize_route(spark, d):
    p = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return view(spark, d, "pages").select("page_id", X.normalize_route(p).alias("route"), X.normalize_hex_route(p).alias("hex_route"))


@query(f"""
SELECT page_id, len(s) = 2 AND s[1] = 'en' AS matches FROM (SELECT page_id, string_split(trim({_PATH}, '/'), '/') AS s FROM pages) p""")
def f07_route_matches(spark, d):
    p = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return view(spark, d, "pages").select("page_id", X.route_matches(F.lit("/en/{id}"), p).alias("matches"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'items' END AS table_name FROM orders")
def f08_sql_table(spark, d):
    o = view(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    sql = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("SELECT a from `orders` WHERE k = "), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("update items SET k = "), k)).otherwise(F.concat(F.lit("COMMIT "), k))
    return o.select("o_orderkey", X.extract_sql_table(sql).alias("table_name"))


def _source(language: str = "python"):
    """Lines of code made of each document's words, and its whole text behind them."""
    w = F.split(F.regexp_replace("text", r"[^A-Za-z ]", ""), " ")
    word = lambda i: F.coalesce(F.nullif(F.get(w, F.lit(i)), F.lit("")), F.lit("x"))
    i = F.col("doc_id").cast("string")
    if language == "python":
        return F.concat(F.lit("def f"), i, F.lit("(a):\n  # TODO look at "), word(0), F.lit("\n  log.info('"), word(1), F.lit("')\n  return g"), i, F.lit("(len(a))\n"), F.coalesce("text", F.lit("")))
    return F.concat(F.lit("import a from 'm"), i, F.lit("'\nconst b = require('"), word(0), F.lit("')\napp.get('/p"), i, F.lit("', h"), i, F.lit(")\n"), F.coalesce("text", F.lit("")))


@query("SELECT doc_id, coalesce(nullif(w[2], ''), 'x') AS patterns FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents) d")
def f09_log_patterns(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(X.extract_log_patterns(_source()), ",").alias("patterns"))


@query("SELECT doc_id, concat('info,g', doc_id) AS calls FROM documents")
def f10_calls(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(X.extract_calls(_source(), F.concat(F.lit("f"), F.col("doc_id").cast("string"))), ",").alias("calls"))


@query("SELECT doc_id, concat('m', doc_id, ',', coalesce(nullif(w[1], ''), 'x')) AS imports, concat('h', doc_id, '=GET /p', doc_id) AS route FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents) d")
def f11_imports_routes(spark, d):
    """F11, F12."""
    s = _source("javascript")
    r = X.extract_routes(s, "javascript")[0]
    return view(spark, d, "documents").select("doc_id", F.array_join(X.extract_imports(s, "javascript"), ",").alias("imports"), F.concat(r["handler"], F.lit("="), r["route"]).alias("route"))


@query("SELECT doc_id, concat('def f', doc_id, '(a):') AS first_line, (3 + len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^ *(#|//)'))))::INT AS lines FROM documents")
def f13_strip_comments(spark, d):
    s = F.split(X.strip_comments(_source()), "\n")
    return view(spark, d, "documents").select("doc_id", s[0].alias("first_line"), F.size(s).alias("lines"))


@query("SELECT doc_id, concat('return g', doc_id, '(len(a))') AS context, CASE WHEN length(text) > 15 THEN concat(substr(text, 1, 15), '...') ELSE text END AS redacted FROM documents")
def f14_match_context(spark, d):
    """F14, F15."""
    return view(spark, d, "documents").select("doc_id", X.match_context(_source(), r"return\s+g").alias("context"), X.redact_secret(F.col("text")).alias("redacted"))


@query("SELECT 'python' AS language")
def f18_primary_language(spark, d):
    return X.primary_language(view(spark, d, "units_docs"))


@query("SELECT doc_id, concat('Code quality: TODO look at ', coalesce(nullif(w[1], ''), 'x')) AS error FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents) d")
def f19_static_error(spark, d):
    return view(spark, d, "documents").select("doc_id", X.detect_static_error(_source(), F.lit(None).cast("string")).alias("error"))


@query("SELECT unit_id, source_file AS file, start_line AS line FROM units_docs")
def f20_parse_location(spark, d):
    return view(spark, d, "units_docs").select("unit_id", X.parse_location(F.concat("source_file", F.lit(":"), F.col("start_line").cast("string"))).alias("l")).select("unit_id", "l.file", "l.line")


@query(f"SELECT DISTINCT concat('http: ', url) AS label FROM pages UNION SELECT DISTINCT concat('route: ', {_PATH}) FROM pages ORDER BY label LIMIT 10")
def f21_source_locations(spark, d):
    p = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return X.span_source_locations(view(spark, d, "pages").select(F.create_map(F.lit("http.url"), "url", F.lit("http.route"), p).alias("attributes")))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query(f"""
WITH {_TOK} SELECT count(*) AS units, count(CASE WHEN unit_type = 'function' THEN 1 END) AS functions, count(CASE WHEN unit_type = 'method' THEN 1 END) AS methods, count(CASE WHEN unit_type = 'class' THEN 1 END) AS classes,
  count(DISTINCT source_file) AS files, count(CASE WHEN unit_id % 4 = 0 THEN 1 END) AS log_patterns, (SELECT count(DISTINCT token) FROM tok) AS unique_tokens FROM units_docs""")
def a08_index_stats(spark, d):
    return A.index_stats(_units(spark, d))


@query("""
SELECT source_file, count(CASE WHEN unit_type <> 'class' THEN 1 END) AS functions, count(CASE WHEN unit_type = 'class' THEN 1 END) AS classes, count(*) AS total, count(*) * 100 // max(count(*)) OVER () AS pct
FROM units_docs GROUP BY 1 ORDER BY total DESC, source_file LIMIT 18""")
def a09_file_breakdown(spark, d):
    return A.file_breakdown(view(spark, d, "units_docs"))


@query("""
SELECT path, kind AS element_type, count(*) AS keys FROM (SELECT concat(source, '/.env') AS path, CASE doc_id % 3 WHEN 0 THEN 'connection' WHEN 1 THEN 'credential' ELSE 'environment' END AS kind FROM documents WHERE source IS NOT NULL) x GROUP BY ALL""")
def a14_env_properties(spark, d):
    docs = view(spark, d, "documents").filter("source is not null")
    i = F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("DB_HOST_"), i)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("API_KEY_"), i)).otherwise(F.concat(F.lit("MODE_"), i))
    rows = docs.select(F.concat("source", F.lit("/.env")).alias("path"), F.concat(key, F.lit("="), i).alias("content"))
    return C.env_properties(rows).select("path", "element_type", F.size("properties").cast("bigint").alias("keys"))


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"""
WITH {_TOK}, c AS (SELECT unit_id, token, count(*) AS c FROM tok GROUP BY ALL), m AS (SELECT unit_id, max(c) AS m FROM c GROUP BY 1)
SELECT unit_id, count(*) AS terms, round(sum(c / m), 4) AS weight FROM c JOIN m USING (unit_id) GROUP BY 1""")
def s01_build_tfidf(spark, d):
    p, _ = S.build_tfidf(_units(spark, d))
    return p.groupBy("unit_id").agg(F.count("*").alias("terms"), F.round(F.sum("tf"), 4).alias("weight"))


def _asked(spark, d) -> DataFrame:
    """Benchmark items as queries: their first words."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("text"))


_TFIDF = f"""
WITH {_TOK}, c AS (SELECT unit_id, token, count(*) AS c FROM tok GROUP BY ALL), m AS (SELECT unit_id, max(c) AS m FROM c GROUP BY 1), f AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
q AS (SELECT item_id AS query_id, t AS token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:6], ' ')), '[a-z_][a-z0-9_]*')) AS t FROM benchmark) x WHERE length(t) > 2 AND t NOT IN ('{_STOP}') GROUP BY ALL),
s AS (SELECT query_id, unit_id, round(sum(c / m * times * ln((SELECT count(*) FROM units_docs) / (1 + df))), 6) AS score FROM q JOIN f USING (token) JOIN c USING (token) JOIN m USING (unit_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s WHERE score > 0)"""


@query(_TFIDF + " SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 5")
def s02_search_tfidf(spark, d):
    u = _units(spark, d)
    postings, df = S.build_tfidf(u, _asked(spark, d))
    return S.search_tfidf(_asked(spark, d), postings, df, u.count(), 5).drop("matched_terms")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS unit_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 10 AND score > 0""")
def s03_vector_top_k(spark, d):
    e = view(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    return S.vector_top_k(e.filter("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id"), e, 10)


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS unit_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 10 AND score > 0""")
def s03_vector_index(spark, d):
    """S03 by an inverted file, with as many lists as hold all neighbours of the measured queries."""
    e = view(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    return S.vector_top_k_indexed(e.filter("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id"), S.build_vector_index(e), 10, recall=1.0)


@query("""
WITH p AS (SELECT unit_id, lower(substr(body_text, 1, 12)) AS p FROM units_docs WHERE unit_id % 4 = 0), q AS (SELECT item_id AS query_id, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) AS q FROM benchmark),
s AS (SELECT query_id, unit_id, greatest(0.5, round(len(list_intersect(list_distinct(regexp_split_to_array(p, '\\s+')), list_distinct(regexp_split_to_array(q, '\\s+')))) / len(list_distinct(regexp_split_to_array(q, '\\s+'))), 6))::DOUBLE AS score
  FROM p JOIN q ON contains(p, q) OR contains(q, p)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def s04_search_log_pattern(spark, d):
    return S.search_log_pattern(_asked(spark, d), _units(spark, d))


@query("""
WITH p AS (SELECT unit_id, lower(substr(body_text, 1, 12)) AS p FROM units_docs WHERE unit_id % 4 = 0),
q AS (SELECT unit_id AS query_id, lower(CASE WHEN unit_id % 8 = 0 THEN body_text ELSE substr(body_text, 3, 6) END) AS q FROM units_docs WHERE unit_id % 4 = 0),
s AS (SELECT query_id, unit_id, greatest(0.5, round(len(list_intersect(list_distinct(regexp_split_to_array(p, '\\s+')), list_distinct(regexp_split_to_array(q, '\\s+')))) / len(list_distinct(regexp_split_to_array(q, '\\s+'))), 6))::DOUBLE AS score
  FROM p JOIN q ON contains(p, q) OR contains(q, p)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def s04_log_pattern_hits(spark, d):
    """S04 with log lines that hold a pattern (whole texts) and lines that a pattern holds."""
    lines = view(spark, d, "units_docs").filter("unit_id % 4 = 0").select(F.col("unit_id").alias("query_id"), F.when(F.col("unit_id") % 8 == 0, F.col("body_text")).otherwise(F.substring("body_text", 3, 6)).alias("text"))
    return S.search_log_pattern(lines, _units(spark, d))


@query(
    _TFIDF
    + """, n AS (SELECT query_id, qualified_name, rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 10 UNION ALL SELECT query_id, qualified_name, 11 - rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 10),
z AS (SELECT query_id, qualified_name, round(sum(1 / (60 + rank)), 6) AS score FROM n GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name) AS rank FROM z)
SELECT query_id, qualified_name, score, rank::INT AS rank FROM y WHERE rank <= 5"""
)
def s05_rrf_fuse(spark, d):
    u = _units(spark, d)
    postings, df = S.build_tfidf(u, _asked(spark, d))
    hits = S.search_tfidf(_asked(spark, d), postings, df, u.count(), 10).join(u.select("unit_id", "qualified_name"), "unit_id")
    return S.rrf_fuse([hits, hits.withColumn("rank", 11 - F.col("rank"))], top_k=5)


@query("SELECT doc_id AS query_id, doc_id AS unit_id FROM documents WHERE doc_id % 20 = 0")
def s06_lookup_name(spark, d):
    u = view(spark, d, "units_docs")
    q = u.filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), F.when(F.col("unit_id") % 40 == 0, F.col("name")).otherwise(F.col("qualified_name")).alias("text"))
    return S.lookup_name(q, u).select("query_id", "unit_id")


@query("SELECT unit_id AS query_id, unit_id, (CASE WHEN unit_id % 20 = 0 THEN 3 ELSE 2 END)::DOUBLE AS score FROM units_docs WHERE route_path IS NOT NULL")
def s06_lookup_route(spark, d):
    u = view(spark, d, "units_docs")
    q = u.filter("route_path is not null").select(F.col("unit_id").alias("query_id"), F.when(F.col("unit_id") % 20 == 0, F.col("route_path")).otherwise(F.substring_index("route_path", " ", -1)).alias("text"))
    return S.lookup_route(q, u).select("query_id", "unit_id", "score")


@query("WITH x AS (SELECT doc_id, doc_id % 20 = 0 AS p FROM documents) SELECT doc_id AS query_id, (SELECT min(doc_id) FROM documents WHERE doc_id % 100 = 0) AS unit_id FROM x WHERE p")
def s06_lookup_route_fuzzy(spark, d):
    u = view(spark, d, "units_docs").withColumn("route_path", F.when(F.col("unit_id") % 100 == 0, F.lit("GET /api/{id}/items/{id}")))
    i = F.col("unit_id").cast("string")
    q = view(spark, d, "units_docs").filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), F.concat(F.lit("/api/"), i, F.lit("/items/7")).alias("text"))
    return S.lookup_route_fuzzy(q, u).select("query_id", "unit_id")


@query("""
WITH q AS (SELECT item_id AS query_id, lower(array_to_string(string_split(text, ' ')[3:5], ' ')) AS t FROM benchmark),
r AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY unit_id) AS rank FROM units_docs JOIN q ON contains(lower(body_text), t) WHERE unit_type <> 'class')
SELECT query_id, unit_id FROM r WHERE rank <= 3""")
def s06_lookup_body(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("text"))
    return S.lookup_body(b, view(spark, d, "units_docs")).select("query_id", "unit_id")


@query("SELECT r_regionkey::BIGINT AS query_id, count(*) AS units FROM region, units_docs WHERE contains(source_file, concat('src', r_regionkey, '/')) GROUP BY 1")
def s06_lookup_path(spark, d):
    q = view(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.concat(F.lit("SRC"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("text"))
    return S.lookup_path(q, view(spark, d, "units_docs"), 1 << 30).groupBy("query_id").agg(F.count("*").alias("units"))


@query("SELECT u.unit_id AS query_id, count(*) AS units FROM units_docs u JOIN units_docs v USING (source_file) WHERE u.unit_id % 20 = 0 GROUP BY 1")
def s06_lookup_file(spark, d):
    u = view(spark, d, "units_docs")
    q = u.filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), F.col("source_file").alias("text"))
    return S.lookup_file(q, u, 1 << 30).groupBy("query_id").agg(F.count("*").alias("units"))


@query("""
WITH u AS (SELECT unit_id, lower(name) AS n, lower(qualified_name) AS q, lower(source_file) AS p, lower(substr(body_text, 1, 2000)) AS b FROM units_docs WHERE unit_type <> 'class'),
w AS (SELECT item_id AS query_id, lower(x) AS w FROM (SELECT item_id, unnest(string_split(text, ' ')[1:4]) AS x FROM benchmark) y WHERE length(x) > 2),
s AS (SELECT query_id, unit_id, sum(CASE WHEN contains(n, w) THEN 3 WHEN contains(q, w) THEN 2 WHEN contains(p, w) THEN 1.5 ELSE 1 END)::DOUBLE AS score FROM u JOIN w ON contains(n, w) OR contains(q, w) OR contains(p, w) OR contains(b, w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
SELECT query_id, unit_id, score, rank::INT AS rank FROM r WHERE rank <= 3""")
def s06_lookup_keywords(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.slice(F.split("text", " "), 1, 4).alias("keywords"))
    return S.lookup_keywords(b, view(spark, d, "units_docs"))


@query(_TFIDF + " SELECT query_id, qualified_name, score, rank::INT AS rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 10")
def s08_hybrid_search(spark, d):
    return S.hybrid_search(_asked(spark, d), _units(spark, d))


@query(
    _TFIDF
    + """, h AS (SELECT query_id, qualified_name, score, rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 5),
n AS (SELECT item_id AS query_id, qualified_name, 1.0::DOUBLE AS score, 0 AS rank FROM benchmark JOIN units_docs ON unit_id = item_id WHERE (item_id, qualified_name) NOT IN (SELECT (query_id, qualified_name) FROM h))
SELECT query_id, qualified_name, score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM (SELECT * FROM n UNION ALL SELECT * FROM h) x"""
)
def s09_retrieve(spark, d):
    q = _asked(spark, d).withColumn("name", F.concat(F.lit("f"), F.col("query_id").cast("string")))
    return S.retrieve(q, _units(spark, d))


@query(
    _TFIDF
    + """, x AS (SELECT query_id, length(concat('# ', qualified_name, ' (', source_file, ':', start_line, ')')) + 1 + length(signature) + 1 + length(array_to_string(string_split(coalesce(body_text, ''), chr(10))[1:50], chr(10))) AS n FROM r JOIN units_docs USING (unit_id) WHERE rank <= 3)
SELECT query_id, (sum(n) + 2 * (count(*) - 1))::INT AS length FROM x GROUP BY 1"""
)
def s10_context_window(spark, d):
    u = _units(spark, d)
    w = S.context_window(S.hybrid_search(_asked(spark, d), u, k=3), u)
    return w.select("query_id", F.length("context").alias("length"))


@query(
    _TFIDF
    + """, a AS (SELECT query_id, qualified_name, 0 AS l, rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 3 UNION ALL SELECT query_id, qualified_name, 1, rank FROM r JOIN units_docs USING (unit_id) WHERE rank <= 6),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, qualified_name ORDER BY l, rank) AS no FROM a)
SELECT query_id, qualified_name, row_number() OVER (PARTITION BY query_id ORDER BY l, rank)::INT AS rank FROM b WHERE l = 0 OR no = 1"""
)
def w09_merge_results(spark, d):
    h = S.hybrid_search(_asked(spark, d), _units(spark, d), k=6).select("query_id", "qualified_name", "rank")
    return A.merge_results(h.filter("rank <= 3"), h)


def _named_spans(spark, d) -> DataFrame:
    """A span for each page: every kind of name and attributes that the cascade knows."""
    p = view(spark, d, "pages")
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("svc.f"), i)).when(k == 1, F.concat(F.lit("GET /p"), i)).when(k == 2, F.concat(F.lit("db op "), F.regexp_replace(i, "([0-9])", "$1 "))).when(k == 3, F.concat(F.lit("code"), i)).otherwise(F.concat(F.lit("zz"), i))
    attributes = F.map_concat(
        F.when(k == 1, F.create_map(F.lit("http.target"), F.lit("/api/77/items/8"))).otherwise(_NONE()),
        F.when(k == 2, F.create_map(F.lit("db.statement"), F.lit("SELECT 1 FROM thand"))).otherwise(_NONE()),
        F.when(k == 3, F.create_map(F.lit("code.function"), F.lit("f3"))).otherwise(_NONE()),
    )
    return p.select(name.alias("name"), attributes.alias("attributes"), F.lit("src1-service").alias("service"), F.col("page_id").cast("double").alias("start_time_ms"), F.concat(F.lit("s"), i).alias("span_id"))


def _NONE():  # noqa: N802
    return F.create_map().cast("map<string,string>")


@query("""
WITH m AS (SELECT min(doc_id) AS r FROM documents WHERE doc_id % 100 = 50), t AS (SELECT min(unit_id) AS b FROM units_docs WHERE unit_type <> 'class' AND contains(lower(body_text), 'thand'))
SELECT concat('svc.f', page_id) AS name, page_id AS unit_id, 'exact' AS match_type FROM pages WHERE page_id % 5 = 0 AND page_id IN (SELECT doc_id FROM documents)
UNION ALL SELECT concat('GET /p', page_id), r, 'route_fuzzy' FROM pages, m WHERE page_id % 5 = 1
UNION ALL SELECT concat('db op ', regexp_replace(CAST(page_id AS VARCHAR), '([0-9])', '\\1 ', 'g')), b, 'db_pattern' FROM pages, t WHERE page_id % 5 = 2 AND b IS NOT NULL
UNION ALL SELECT concat('code', page_id), 3, 'code_attr' FROM pages WHERE page_id % 5 = 3""")
def j06_correlate_spans(spark, d):
    u = _units(spark, d).withColumn("route_path", F.when(F.col("unit_id") % 100 == 50, F.lit("GET /api/{id}/items/{id}")))
    return K.correlate_spans(_named_spans(spark, d), u)


@query("SELECT count(*) AS total, count(CASE WHEN page_id IN (SELECT doc_id FROM documents) THEN 1 END) AS hits, round(count(CASE WHEN page_id IN (SELECT doc_id FROM documents) THEN 1 END) / count(*), 4) AS accuracy FROM pages WHERE page_id % 5 = 0")
def s11_correlation_accuracy(spark, d):
    s, u = _named_spans(spark, d), _units(spark, d)
    labels = s.filter("name like 'svc.f%'").select("name", F.substring_index("name", ".", -1).alias("expected"))
    return K.correlation_accuracy(K.correlate_spans(s, u), labels, u)


# --- code facts -------------------------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT a.unit_id AS caller, b.unit_id AS callee FROM (SELECT unit_id, unnest([concat('f', unit_id // 2), concat('f', unit_id // 3)]) AS c FROM units_docs) a JOIN units_docs b ON b.name = c AND a.unit_id <> b.unit_id""")
def c04_call_edges(spark, d):
    return C.call_edges(_units(spark, d))


@query("SELECT DISTINCT concat('f', a.unit_id) AS a, c AS b FROM (SELECT unit_id, unnest([concat('f', unit_id // 2), concat('f', unit_id // 3)]) AS c FROM units_docs) a WHERE c <> concat('f', unit_id) AND c IN (SELECT name FROM units_docs)")
def c05_call_edges_by_name(spark, d):
    return C.call_edges_by_name(_units(spark, d))


@query("SELECT b AS a, count(DISTINCT a) AS fanout FROM edges_docs GROUP BY b HAVING count(DISTINCT a) > 3")
def c06_high_fanout(spark, d):
    return C.high_fanout(view(spark, d, "edges_docs").select(F.col("b").alias("a"), F.col("a").alias("b")), 3)


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT concat('f', unit_id) AS a, c AS b FROM (SELECT unit_id, unnest([concat('f', unit_id // 2), concat('f', unit_id // 3)]) AS c FROM units_docs) x WHERE c <> concat('f', unit_id) AND c IN (SELECT name FROM units_docs)),
g AS (SELECT a, b FROM d UNION SELECT b, a FROM d WHERE CAST(substr(a, 2) AS BIGINT) % 7 = 0),
p AS (SELECT a AS s, b AS e, [a, b] AS path FROM g WHERE a < b
  UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN g ON a = e WHERE b >= s AND e <> s AND NOT list_contains(path[2:], b) AND len(path) <= 6)
SELECT DISTINCT array_to_string(list_sort(list_distinct(path)), ',') AS members FROM p WHERE e = s""")
def c07_circular_dependencies(spark, d):
    calls = C.call_edges_by_name(_units(spark, d))
    c = G.find_cycles(calls.union(calls.filter("try_cast(substr(a, 2) AS bigint) % 7 = 0").select("b", "a")))
    return c.select(F.array_join("members", ",").alias("members"))


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT concat('f', unit_id) AS a, c AS b FROM (SELECT unit_id, unnest([concat('f', unit_id // 2), concat('f', unit_id // 3)]) AS c FROM units_docs) x WHERE c <> concat('f', unit_id) AND c IN (SELECT name FROM units_docs)),
g AS (SELECT a, b FROM d UNION SELECT b, a FROM d WHERE CAST(substr(a, 2) AS BIGINT) % 7 = 0),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT component, count(*) AS size FROM (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1) c GROUP BY 1""")
def c07_dependency_components(spark, d):
    """C07 for cycles of any length: the components that they lie in."""
    calls = C.call_edges_by_name(_units(spark, d))
    c = Y.circular_dependencies(calls.union(calls.filter("try_cast(substr(a, 2) AS bigint) % 7 = 0").select("b", "a")))
    return c.select("component", "size")


@query("SELECT unit_id, name, source_file, start_line, end_line - start_line AS lines FROM units_docs WHERE unit_type = 'function' AND end_line - start_line > 80")
def c08_large_functions(spark, d):
    return C.large_functions(view(spark, d, "units_docs"))


@query("SELECT unit_id, name FROM units_docs WHERE unit_type = 'function' AND route_path IS NULL AND unit_id NOT IN (SELECT b FROM edges_docs)")
def c09_dead_code(spark, d):
    return C.dead_code(view(spark, d, "units_docs"), view(spark, d, "edges_docs").toDF("caller", "callee")).select("unit_id", "name")


@query("SELECT a AS caller, b AS callee, concat('f', b) AS callee_name, 2 AS required, 1 AS given FROM edges_docs WHERE b = a // 2 AND a % 3 = 0")
def c10_arity_mismatch(spark, d):
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.lit("def x(self, a, b, c=1)").alias("signature"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 3 == 0, "(1)").otherwise("(1, 2)")).alias("body_text"))
    return C.arity_mismatch(docs, view(spark, d, "edges_docs").toDF("caller", "callee"))


@query("""
WITH c AS (SELECT source_file AS source, unnest([concat('f', unit_id // 2), concat('f', unit_id // 3), 'len']) AS name FROM units_docs)
SELECT c.source, u.source_file AS target, count(*)::BIGINT AS calls FROM c JOIN units_docs u USING (name) WHERE c.source <> u.source_file GROUP BY ALL HAVING count(*) > 1""")
def j09_tight_coupling(spark, d):
    return C.tight_coupling(_units(spark, d), 1)


@query("""
SELECT unit_id, CASE WHEN route_path IS NOT NULL THEN 0 ELSE 2 END AS kind, coalesce(route_path, name) AS label FROM units_docs WHERE route_path IS NOT NULL OR (unit_type <> 'class' AND unit_id NOT IN (SELECT b FROM edges_docs))""")
def w07_entry_points(spark, d):
    return C.entry_points(view(spark, d, "units_docs"), view(spark, d, "edges_docs").toDF("caller", "callee")).select("unit_id", "kind", "label")


@query(r"""
WITH RECURSIVE e AS (SELECT unit_id FROM units_docs WHERE route_path IS NOT NULL OR (unit_type <> 'class' AND unit_id NOT IN (SELECT b FROM edges_docs)) ORDER BY CASE WHEN route_path IS NOT NULL THEN 0 ELSE 2 END, coalesce(route_path, name), unit_id LIMIT 15),
p AS (SELECT [unit_id] AS path FROM e UNION ALL SELECT list_append(path, b) FROM p JOIN edges_docs ON a = path[-1] WHERE NOT list_contains(path, b) AND len(path) < 12),
k AS (SELECT path, len(path) AS n, list_transform(path, lambda i: lpad(CAST(i AS VARCHAR), 12, '0')) AS parts FROM p),
o AS (SELECT *, array_to_string(parts, '/') AS key, array_to_string(parts[1:n - 1], '/') AS up, row_number() OVER (ORDER BY array_to_string(parts, '/')) - 1 AS no FROM k),
below AS (SELECT array_to_string(parts[1:i], '/') AS key, count(*) AS below FROM (SELECT parts, unnest(range(1, n + 1)) AS i FROM k) x GROUP BY 1),
t AS (SELECT o.*, below, no * 2 - (n - 1) AS opened, regexp_matches(body_text, 'TODO|FIXME|HACK|XXX|BUG|\bexcept\s*:') OR (route_path IS NOT NULL AND (contains(body_text, 'console.log(') OR (contains(body_text, 'print(') AND NOT contains(body_text, 'print_')))) AS bad
  FROM o JOIN below USING (key) JOIN units_docs ON unit_id = path[-1])
SELECT 'ENTRY' AS event_type, substr(sha256(key), 1, 16) AS span_id, CASE WHEN n > 1 THEN substr(sha256(up), 1, 16) END AS parent_span_id, (n - 1)::INT AS depth, round(opened / 1000, 4) AS timestamp FROM t
UNION ALL SELECT CASE WHEN bad THEN 'ERROR' ELSE 'EXIT' END, substr(sha256(key), 1, 16), CASE WHEN n > 1 THEN substr(sha256(up), 1, 16) END, (n - 1)::INT, round((opened + 2 * below - 1) / 1000, 4) FROM t""")
def c12_static_trace(spark, d):
    t = C.static_trace(_units(spark, d), view(spark, d, "edges_docs").toDF("caller", "callee"))
    return t.select("event_type", "span_id", "parent_span_id", "depth", F.round("timestamp", 4).alias("timestamp"))



@query(r"""
SELECT unit_id, 'hardcoded_secret' AS family, 0.75::DOUBLE AS confidence FROM units_docs WHERE regexp_matches(body_text, '(?i)(?:api_key|apikey|secret|password|token|auth)\s*=\s*["''][A-Za-z0-9_\-]{8,}["'']|(?-i:AWS_SECRET|AWS_ACCESS|OPENAI_API|ANTHROPIC|sk-[a-zA-Z0-9]{20,})')
UNION ALL SELECT unit_id, 'weak_crypto', 0.8 FROM units_docs WHERE regexp_matches(body_text, '(?i)DES|RC4|Blowfish')""")
def c13_pattern_findings(spark, d):
    return C.pattern_findings(view(spark, d, "units_docs")).select("unit_id", "family", "confidence")


_HITS = {
    "sql_injection": ('db.execute(f"select 1")', 0.85), "hardcoded_secret": ('api_key = "abcd1234efgh"', 0.75), "unsafe_deserialization": ("pickle.loads(x)", 0.9), "ssrf": ("requests.get(url)", 0.7),
    "path_traversal": ("open(filename)", 0.7), "xss": ("el.innerHTML = query", 0.75), "open_redirect": ("redirect(next_url)", 0.7), "weak_crypto": ("md5(password)", 0.8),
}


@query(f"""
WITH k AS (SELECT unnest(range(0, 8)) AS n, unnest({list(_HITS)}) AS family, unnest({[c for _, c in _HITS.values()]})::DOUBLE AS confidence)
SELECT doc_id AS unit_id, family, confidence FROM documents JOIN k ON n = doc_id % 8 UNION ALL SELECT doc_id, 'own', 0.5 FROM documents WHERE doc_id % 8 = 2""")
def c13_rule_families(spark, d):
    """A line that meets each of the families in turn, above the text as comments, and a rule of one's own."""
    lines = F.array(*(F.lit(line) for line, _ in _HITS.values()))
    text = F.regexp_replace(F.coalesce("body_text", F.lit("")), "(?m)^|[\\r\\u0085\\u2028\\u2029]", "# ")
    u = _units(spark, d).withColumn("body_text", F.concat(F.get(lines, (F.col("unit_id") % 8).cast("int")), F.lit("\n"), text))
    own = spark.createDataFrame([("own", "low", 0.5, 0, "pickle")], "family string, severity string, confidence double, no int, pattern string")
    return C.pattern_findings(u, C.rules_table(spark, own)).select("unit_id", "family", "confidence")


@query("SELECT unit_id, 'data' AS taint FROM units_docs")
def c14_tainted_params(spark, d):
    return view(spark, d, "units_docs").select("unit_id", F.array_join(C.tainted_params(F.col("signature")), ",").alias("taint"))


@query("SELECT doc_id, doc_id % 2 = 0 AS near FROM documents")
def c15_taint_near_sink(spark, d):
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, "request").otherwise(""), F.lit(" execute("), F.repeat(F.lit("x"), 300), F.lit("request "), F.coalesce("text", F.lit("")))
    return view(spark, d, "documents").select("doc_id", C.taint_near_sink(body, F.lit(r"execute\("), F.array(F.lit("request"))).alias("near"))


@query("SELECT doc_id * 2 AS caller, doc_id AS callee FROM documents WHERE doc_id % 3 = 0 AND doc_id > 0 AND doc_id * 2 IN (SELECT doc_id FROM documents)")
def c16_cross_function_taint(spark, d):
    i = F.col("unit_id")
    body = F.concat(F.when(i % 2 == 0, F.concat(F.lit("g"), (i / 2).cast("bigint").cast("string"))).otherwise(F.lit("none")), F.when(i % 3 == 0, " execute(f'x') ").otherwise(" "), F.coalesce("body_text", F.lit("")))
    u = view(spark, d, "units_docs").select("unit_id", F.concat(F.lit("g"), i.cast("string")).alias("name"), "source_file", "signature", body.alias("body_text"))
    return C.cross_function_taint(u).select("caller", "callee")


@query("SELECT count(*) AS n FROM units_docs WHERE route_path IS NOT NULL AND NOT regexp_matches(body_text, 'login_required|requires_auth|authenticated|jwt_required|permission_required|Depends') HAVING count(*) > 3")
def c17_missing_auth(spark, d):
    return C.missing_auth(view(spark, d, "units_docs")).select("n")


@query("SELECT 'GET' AS method, substr(route_path, 5) AS path, name AS handler, concat(source_file, ':', start_line) AS location FROM units_docs WHERE route_path IS NOT NULL")
def c18_route_inventory(spark, d):
    return C.route_inventory(view(spark, d, "units_docs"))


@query("SELECT replace(substr(source_file, 1, length(source_file) - 3), '/', '.') AS module, string_agg(DISTINCT name, ',' ORDER BY name) AS functions FROM units_docs WHERE unit_type <> 'class' GROUP BY 1")
def c19_instrumentation_targets(spark, d):
    return C.instrumentation_targets(view(spark, d, "units_docs")).withColumn("functions", F.array_join("functions", ","))


_ISSUES = """
WITH RECURSIVE p AS (SELECT a AS s, b AS e, [a, b] AS path FROM edges_docs WHERE a < b
  UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN edges_docs ON a = e WHERE b >= s AND e <> s AND NOT list_contains(path[2:], b) AND len(path) <= 6),
rings AS (SELECT DISTINCT list_sort(list_distinct(path)) AS members FROM p WHERE e = s),
issues AS (
  SELECT 'dead_code' AS type, 'info' AS severity, concat('Never called: ', name) AS summary, CAST(unit_id AS VARCHAR) AS subject FROM units_docs WHERE unit_type = 'function' AND route_path IS NULL AND unit_id NOT IN (SELECT b FROM edges_docs)
  UNION ALL SELECT 'circular_dependency', 'warning', concat('Circle of calls: ', array_to_string(members, ' > ')), CAST(members[1] AS VARCHAR) FROM (SELECT members FROM rings ORDER BY len(members), members LIMIT 5) x
  UNION ALL SELECT 'complexity', 'info', concat(name, ' has ', end_line - start_line, ' lines'), CAST(unit_id AS VARCHAR) FROM units_docs WHERE unit_type = 'function' AND end_line - start_line > 80
  UNION ALL SELECT 'complexity', 'info', concat('Calls ', n, ' functions'), CAST(a AS VARCHAR) FROM (SELECT a, count(DISTINCT b) AS n FROM edges_docs GROUP BY a) x WHERE n > 10)"""


@query(_ISSUES + " SELECT * FROM issues")
def c20_structural_issues(spark, d):
    return C.structural_issues(view(spark, d, "units_docs"), view(spark, d, "edges_docs").toDF("caller", "callee"))


@query(_ISSUES + " SELECT severity, count(*) AS count FROM issues GROUP BY 1")
def a13_issue_counts(spark, d):
    return C.issue_counts(C.structural_issues(view(spark, d, "units_docs"), view(spark, d, "edges_docs").toDF("caller", "callee")))


@query()
def r12_code_findings(spark, d):
    return C.code_findings(_units(spark, d)).groupBy("agent_name", "finding_type", "severity").agg(F.count("*").alias("findings"))


# --- files ------------------------------------------------------------------------------------------------------------


def _files(spark, d, path: str, content: str, mark: str) -> DataFrame:
    """A file for each document: `content`, in which {} is the doc_id, and the whole text behind it as comment lines."""
    i = F.col("doc_id").cast("string")
    fill = lambda t: F.concat(*(x for k, part in enumerate(t.split("{}")) for x in ([i] if k else []) + [F.lit(part)]))
    note = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\r", " "), "(?m)^", mark)
    return view(spark, d, "documents").select("doc_id", fill(path).alias("path"), F.concat(fill(content), note).alias("content"))


@query("SELECT concat('d', doc_id, '.py') AS source_file, concat('f', doc_id) AS name, concat('d', doc_id, '.f', doc_id) AS qualified_name, 'function' AS unit_type, 1 AS start_line, 2 AS end_line, concat('g', doc_id, ',len') AS calls FROM documents")
def c01_code_units(spark, d):
    u = C.extract_code_units(_files(spark, d, "d{}.py", "def f{}(a):\n    return g{}(len(a))\n\n", "# "))
    return u.select("source_file", "name", "qualified_name", "unit_type", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


_BRACES = {
    "j{}.ts": 'function f{}(a) {\n  const s = "}" + `{${f("}", `}`)}{`; const r = /[}]/;\n',
    "g{}.go": "func f{}(a int) error {\n\ts := `}` + \"}\"; c := '}'\n",
    "v{}.java": 'class f{} {\n  String s = "}"; char c = \'}\'; /* } */\n',
}
_TAILS = {"j{}.ts": "\n}\nfunction g() { return 1; }\n", "g{}.go": "\n}\nfunc g() {}\n", "v{}.java": "\n}\nclass g { }\n"}


@query("""
WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), k AS (SELECT unnest(['j', 'g', 'v']) AS k, unnest(['.ts', '.go', '.java']) AS e, unnest(['function', 'function', 'class']) AS unit_type)
SELECT concat(k, doc_id, e) AS source_file, concat('f', doc_id) AS name, unit_type, 1 AS start_line, (n + 3)::INT AS end_line FROM l CROSS JOIN k
UNION ALL SELECT concat(k, doc_id, e), 'g', unit_type, (n + 4)::INT, (n + 4)::INT FROM l CROSS JOIN k""")
def c01_brace_units(spark, d):
    """C01 for brace languages: braces in strings, templates, characters and comments; the texts are comments in the first unit."""
    made = [_files(spark, d, path, head, "// { ").withColumn("content", F.concat("content", F.lit(_TAILS[path]))) for path, head in _BRACES.items()]
    u = C.extract_code_units(made[0].unionByName(made[1]).unionByName(made[2]))
    return u.select("source_file", "name", "unit_type", "start_line", "end_line")


@query(r"""
WITH f AS (SELECT doc_id, concat('SELECT k, SUM(v) AS total FROM t', doc_id, ' JOIN u ON a = b GROUP BY k;', chr(10), regexp_replace(translate(text, chr(13), ' '), '(?m)^', '-- ', 'g')) AS c FROM documents)
SELECT concat('m', doc_id, '.sql') AS path, array_to_string(list_concat(list_filter(regexp_extract_all(c, '(?i)\bFROM\s+(\w+(?:\.\w+)*)', 1), lambda t: lower(t) NOT IN ('select', 'where', 'set', 'values', 'null')), regexp_extract_all(c, '(?i)\bJOIN\s+(\w+(?:\.\w+)*)', 1)), ',') AS tables, 'SUM' AS aggregates
FROM f""")
def c02_sql_facts(spark, d):
    f = C.sql_model_facts(_files(spark, d, "m{}.sql", "SELECT k, SUM(v) AS total FROM t{} JOIN u ON a = b GROUP BY k;\n", "-- "))
    return f.select("path", F.array_join("tables", ",").alias("tables"), F.array_join("aggregates", ",").alias("aggregates"))


@query("SELECT concat('c', doc_id, '.yml') AS path, concat('s', doc_id) AS name, 'service' AS element_type, concat('img:', doc_id) AS image FROM documents")
def c03_config_elements(spark, d):
    e = C.config_elements(_files(spark, d, "c{}.yml", "services:\n  s{}:\n    image: img:{}\n", "# "))
    return e.select("path", "name", "element_type", e.properties["image"].alias("image"))


@query("SELECT doc_id AS unit_id, concat('GET /p', doc_id, '/x') AS route_path FROM documents")
def j10_router_prefixes(spark, d):
    edges = C.router_edges(_files(spark, d, "m{}/main.py", "from m{}.api import routes\napp.include_router(routes.router, prefix='/p{}')\n", "# "))
    units = view(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("/api/routes.py")).alias("source_file"), F.lit("GET /x").alias("route_path"))
    return C.resolve_router_prefixes(units, edges).select("unit_id", "route_path")


@query("""
SELECT unit_id, least(64, (SELECT count(*) FROM units_docs)) AS size, 1.0::DOUBLE AS length FROM units_docs
WHERE unit_id IN (SELECT unit_id FROM (SELECT unit_id, unnest(regexp_extract_all(lower(body_text), '[a-z_][a-z0-9_]*')) AS t FROM units_docs) x WHERE length(t) > 2 AND t NOT IN ('%s'))""" % _STOP)
def s07_svd_embeddings(spark, d):
    """64 dimensions over all tokens; tests hold the singular values and vectors against numpy's."""
    v = S.svd_embeddings(_units(spark, d), rounds=3)
    return v.select("unit_id", F.size("vector").cast("bigint").alias("size"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))
