"""DuckDB SQL for the operators that SQL can express."""

import math

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

WARC = r"""
WITH u AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, regexp_replace(trim(url, ' '), '#(?s:.*)$', '') AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head FROM u),
p AS (
  SELECT page_id, digest, CASE WHEN u IS NULL THEN NULL ELSE
    regexp_replace(regexp_replace(lower(head), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(u, length(head) + 1),
       '([?&])utm_[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?', 'g'), '&&+', '&', 'g'), '/$', '') END AS url_key
  FROM h),
r AS (
  SELECT page_id * 4 + no AS record_id, url_key, no, kind, ts, etag, modified FROM (
    SELECT page_id, url_key, 0 AS no, 'response' AS kind, page_id * 10 AS ts, CASE WHEN page_id % 11 <> 0 THEN digest END AS etag, 'day ' || (page_id % 365) AS modified FROM p
    UNION ALL SELECT page_id, url_key, 1, 'revisit', page_id * 10 + 5, CASE WHEN page_id % 11 <> 0 THEN 'W/' || digest END, CASE WHEN page_id % 11 = 0 THEN 'day ' || (page_id % 365) END FROM p
    UNION ALL SELECT page_id, url_key, 2, 'revisit', page_id * 10 + 40, CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE digest END, NULL FROM p
    UNION ALL SELECT page_id, url_key, 3, 'revisit', page_id * 10 - 5, digest, NULL FROM p WHERE page_id % 5 = 0)),
l AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN {'ts': ts, 'id': record_id} END)
    OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM r WHERE url_key IS NOT NULL),
j AS (
  SELECT l.record_id, l.url_key, l.ts, q.record_id AS response_id, l.etag, q.etag AS q_etag, q.ts AS q_ts,
    CASE WHEN q.record_id IS NULL THEN 'no_response'
      WHEN l.etag IS NOT NULL AND q.etag IS NOT NULL THEN CASE WHEN regexp_replace(l.etag, '^W/', '') = regexp_replace(q.etag, '^W/', '') THEN 'resolved' ELSE 'stale' END
      WHEN l.modified IS NOT NULL AND q.modified IS NOT NULL THEN CASE WHEN l.modified = q.modified THEN 'resolved' ELSE 'stale' END
      ELSE 'unproven' END AS outcome
  FROM l LEFT JOIN r q ON q.record_id = l.last.id WHERE l.kind = 'revisit')
SELECT record_id, url_key, ts, response_id, outcome, CASE WHEN outcome = 'resolved' THEN coalesce(etag, q_etag) END AS etag,
  CASE WHEN outcome = 'resolved' THEN 't' || ts END AS date, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type FROM j
UNION ALL SELECT record_id, url_key, ts, NULL, 'no_response', NULL, NULL, NULL FROM r WHERE url_key IS NULL AND kind = 'revisit'
"""


def _url_level(i: int) -> str:
    return f"""
g{i} AS (SELECT host, t, s{i}, sum(n)::BIGINT AS cn, sum(labelled)::BIGINT AS cl, sum(blocked)::BIGINT AS cb FROM t{i} GROUP BY ALL),
l{i} AS (SELECT host, t, count(*) AS kinds, sum(cn)::BIGINT AS pn, sum(cl)::BIGINT AS pl, sum(cb)::BIGINT AS pb FROM g{i} WHERE s{i} <> '' GROUP BY ALL),
c{i} AS (
  SELECT host, t, s{i}, s{i} <> '' AND pn >= 20 AND kinds >= 0.5 * pn AS many,
    cl > 0 AND pl > cl AND abs(cb::DOUBLE / cl - (pb - cb)::DOUBLE / (pl - cl)) <= {math.sqrt(math.log(2 / 0.05) / 2)!r}::DOUBLE * (1 / sqrt(cl) + 1 / sqrt(pl - cl)) AS alike
  FROM g{i} LEFT JOIN l{i} USING (host, t)),
t{i + 1} AS (
  SELECT a.* EXCLUDE (t, g), a.t || CASE WHEN s{i} = '' THEN '' WHEN many THEN '/*' WHEN alike THEN '/+' ELSE '/' || s{i} END AS t,
    a.g || CASE WHEN s{i} = '' THEN '' WHEN many THEN '/*' ELSE '/' || s{i} END AS g
  FROM t{i} a JOIN c{i} USING (host, t, s{i}))"""


URL_FILTER = (
    r"""
WITH RECURSIVE a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM b),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action,
    list_transform([coalesce(p[1], ''), coalesce(p[2], ''), coalesce(p[3], '')], lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
      WHEN regexp_matches(s, '^[0-9]+\.[a-z]+$') THEN '{n.x}' WHEN regexp_matches(s, '^[0-9a-f]{8,}$') THEN '{h}' WHEN regexp_matches(s, '[0-9]{3,}') THEN '{v}' ELSE s END) AS c
  FROM m),
x AS (SELECT page_id, host, path, rule, action, c[1] AS s0, c[2] AS s1, c[3] AS s2, len(p) > 3 AS more FROM v),
t0 AS (SELECT host, s0, s1, s2, more, count(*) AS n, count(action) AS labelled, count(CASE WHEN action = 'block' THEN 1 END) AS blocked, '' AS t, '' AS g FROM x GROUP BY ALL),"""
    + ",".join(_url_level(i) for i in range(3))
    + """,
f AS (SELECT * EXCLUDE (t, g), t || CASE WHEN more THEN '/...' ELSE '' END AS t, g || CASE WHEN more THEN '/...' ELSE '' END AS g FROM t3),
o AS (SELECT *, string_split(host, '.') AS labels FROM f),
h AS (SELECT host, labels, g, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM o GROUP BY ALL),
e AS (SELECT host, g, labelled, blocked, k, array_to_string(labels[len(labels) - k + 1:len(labels)], '.') AS scope FROM (SELECT *, unnest(range(0, len(labels))) AS k FROM h)),
w AS (SELECT k, scope, g, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b FROM e GROUP BY ALL),
n AS (SELECT host, g, k, l, b FROM e JOIN w USING (k, scope, g)),
r AS (
  SELECT host, g, k, (b + 4.0::DOUBLE * 0.5::DOUBLE) / (l + 4.0::DOUBLE) AS p FROM n WHERE k = 0
  UNION ALL
  SELECT n.host, n.g, n.k, (n.b + 4.0::DOUBLE * (0.5::DOUBLE + 0.9::DOUBLE * (r.p - 0.5::DOUBLE))) / (n.l + 4.0::DOUBLE) FROM r JOIN n ON n.host = r.host AND n.g = r.g AND n.k = r.k + 1),
z AS (SELECT host, g, max_by(p, k) AS p FROM r GROUP BY ALL),
j AS (SELECT host, t, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM f GROUP BY ALL),
q AS (SELECT DISTINCT host, t, g, (blocked + 4.0::DOUBLE * (0.5::DOUBLE + 0.9::DOUBLE * (p - 0.5::DOUBLE))) / (labelled + 4.0::DOUBLE) AS purity FROM (SELECT DISTINCT host, t, g FROM f) JOIN j USING (host, t) JOIN z USING (host, g))
SELECT x.page_id, x.host, x.path, x.rule, coalesce(x.action, CASE WHEN q.purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, f.t AS template, q.purity
FROM x JOIN f USING (host, s0, s1, s2, more) JOIN q USING (host, t, g)
"""
)


def _fill(i: int) -> str:
    """Water-filling of level i below the parents' budgets."""
    levels = ("domain", "lang", "source")
    mine, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
    part = f"PARTITION BY {up}" if up else ""
    weight = (
        "CASE domain WHEN 'long' THEN 3 WHEN 'short' THEN 2 ELSE 1 END",
        "CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 2 ELSE 1 END",
        "CASE source WHEN 'src0' THEN 2 ELSE 1 END",
    )[i]
    join = f"JOIN b{i} USING ({up})" if up else "CROSS JOIN b0"
    return f"""
n{i} AS (SELECT {mine}, sum(2 * tokens)::BIGINT AS capacity FROM leaves GROUP BY ALL),
o{i} AS (SELECT *, ({weight})::DOUBLE AS weight FROM n{i} {join}),
q{i} AS (
  SELECT *, coalesce(sum(capacity) OVER a, 0) AS used, coalesce(sum(weight) OVER a, 0) AS gone, sum(weight) OVER ({part}) AS every
  FROM o{i} WINDOW a AS ({part} ORDER BY capacity / weight, {mine} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r{i} AS (SELECT *, (given - used) * weight >= capacity * (every - gone) AS is_full FROM q{i}),
s{i} AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part}) AS held, sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ({part}) AS heavy FROM r{i}),
v{i} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE greatest(least(floor((given - held) * weight / (every - heavy)), capacity), 0) END::BIGINT AS share FROM s{i}),
z{i} AS (
  SELECT *, NOT is_full AND share < capacity AS room, given - sum(share) OVER ({part}) AS over,
    row_number() OVER ({part} ORDER BY NOT (NOT is_full AND share < capacity), weight DESC, {mine}) AS turn FROM v{i}),
b{i + 1} AS (SELECT {mine}, (share + CASE WHEN room AND turn <= over THEN 1 ELSE 0 END)::BIGINT AS given FROM z{i})"""


MIXING = (
    r"""
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(length(text), 0) >= 4000 THEN 'long' ELSE 'short' END AS domain, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
e AS (SELECT * FROM d WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM e GROUP BY ALL),
b0 AS (SELECT least(floor(sum(tokens) * 0.5), sum(2 * tokens))::BIGINT AS given FROM leaves),"""
    + ",".join(_fill(i) for i in range(3))
    + """,
p AS (SELECT domain, lang, source, given // tokens AS epochs, given % tokens AS rest FROM leaves JOIN b3 USING (domain, lang, source)),
x AS (SELECT e.*, p.epochs, p.rest FROM e JOIN p USING (domain, lang, source)),
y AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || epochs || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM x)
SELECT doc_id, domain, lang, source, unnest(range(0, epochs))::BIGINT AS epoch, tokens::BIGINT AS tokens, tokens::BIGINT AS taken FROM x
UNION ALL SELECT doc_id, domain, lang, source, epochs, tokens, least(tokens, rest - ahead)::BIGINT FROM y WHERE ahead < rest
"""
)


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
