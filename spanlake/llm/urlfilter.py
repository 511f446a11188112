"""URL filters: ordered rules, then a tree of path templates judged by labelled purity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, hot_keys, spread_join

#: (action, host, path): a rule fits its host and all subdomains, where the path starts with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule (as host + path) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def segment_class(segment: Column) -> Column:
    """A variable-looking path segment as a wildcard of its kind, others as they are."""
    return (
        F.when(segment.rlike("^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[a-z]+$"), "{n.x}")
        .when(segment.rlike("^[0-9a-f]{8,}$"), "{h}")
        .when(segment.rlike("[0-9]{3,}"), "{v}")
        .otherwise(segment)
    )


def judge_urls(
    pages: DataFrame, rules=RULES, depth: int = 3, distinct_share: float = 0.5, least_rows: int = 20, alpha: float = 0.05, prior: float = 0.5, strength: float = 4.0, carry: float = 0.9, reject_at: float = 0.8
) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, template, purity; a row for each row.

    Rules decide where one fits, and label the rows that the tree learns from. Each host's paths
    form a tree by segment, `depth` segments deep (deeper ones hang on as `...`):
    1. segments that look variable become wildcards of their kind;
    2. a level under a prefix whose children are many and nearly all different (distinct children >=
       distinct_share of at least least_rows rows) becomes one wildcard;
    3. labelled siblings whose share of blocked labels doesn't differ from that of the labelled siblings
       beside them merge into one wildcard branch. The test is Hoeffding's bound at level `alpha`,
       which holds for any number of labels;
    4. a template's purity is (blocked + strength * p) / (labelled + strength), where p comes from the
       same template (before merging) on the host's parent domain, there likewise from the domain
       above, and at the top from `prior`. At every step down p keeps `carry` of its distance from
       `prior`. So branches and hosts without labels take what is known of their shape elsewhere,
       the nearer the more; templates that nothing is known of keep the prior.
    Templates of purity >= reject_at are rejected. Null urls and urls without `://` have an empty host
    and path, which is a host like any other. Repeated rows count once each.

    All tree work is on sums by (host, template), made before any shuffle of rows, with frequent
    hosts and domains spread over tasks.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    for i in range(depth):
        s = F.get(parts, F.lit(i))
        rows = rows.withColumn(f"s{i}", F.coalesce(segment_class(s), F.lit("")))
    rows = rows.withColumn("more", F.size(parts) > depth)
    raw = [f"s{i}" for i in range(depth)]
    sums = rows.groupBy("host", *raw, "more").agg(F.count("*").alias("n"), F.count("m").alias("labelled"), F.sum((F.col("m.action") == "block").cast("long")).alias("blocked"))
    sums = sums.withColumn("blocked", F.coalesce("blocked", F.lit(0)))
    tree = cut(sums.withColumns({"t": F.lit(""), "g": F.lit("")}))
    for i in range(depth):
        tree = _level(tree, f"s{i}", distinct_share, least_rows, alpha)
    deep = F.when(F.col("more"), "/...").otherwise("")
    tree = cut(tree.withColumns({"t": F.concat("t", deep), "g": F.concat("g", deep)}))
    judged = _judged(tree, prior, strength, carry)
    found = spread_join(tree.select("host", *raw, "more", "t", "g"), judged, ["host", "t", "g"]).select("host", *raw, "more", "t", "purity")
    out = rows.join(found, ["host", *raw, "more"])
    verdict = F.coalesce("m.action", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), F.col("t").alias("template"), "purity")


def _level(tree: DataFrame, segment: str, distinct_share: float, least_rows: int, alpha: float) -> DataFrame:
    """Extend each branch's templates by one segment: t by its own or a wildcard, g without merging."""
    child = cut(tree.groupBy("host", "t", segment).agg(F.sum("n").alias("cn"), F.sum("labelled").alias("cl"), F.sum("blocked").alias("cb")))
    real = F.col(segment) != ""
    level = child.filter(real).groupBy("host", "t").agg(F.count("*").alias("kinds"), F.sum("cn").alias("pn"), F.sum("cl").alias("pl"), F.sum("cb").alias("pb"))
    child = spread_join(child, level, ["host", "t"], "left")
    many = (F.col("pn") >= least_rows) & (F.col("kinds") >= distinct_share * F.col("pn"))
    others, off = F.col("pl") - F.col("cl"), F.col("pb") - F.col("cb")
    bound = math.sqrt(math.log(2 / alpha) / 2) * (1 / F.sqrt("cl") + 1 / F.sqrt(others))
    alike = (F.col("cl") > 0) & (others > 0) & (F.abs(F.col("cb") / F.col("cl") - off / others) <= bound)
    own = F.concat(F.lit("/"), F.col(segment))
    step = F.when(~real, "").when(many, "/*").when(alike, "/+").otherwise(own)
    shape = F.when(~real, "").when(many, "/*").otherwise(own)
    child = child.select("host", "t", segment, step.alias("step"), shape.alias("shape"))
    return tree.join(child, ["host", "t", segment]).withColumns({"t": F.concat("t", "step"), "g": F.concat("g", "shape")}).drop("step", "shape")


def _judged(tree: DataFrame, prior: float, strength: float, carry: float) -> DataFrame:
    """(host, t, g, purity): smoothed down the chain of domains, from all hosts to the host's parent, then the host."""
    mine = tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    labels = F.split("host", "\\.")
    scope = F.array_join(F.slice(labels, F.size(labels) - F.col("k") + 1, F.col("k")), ".")
    shapes = tree.groupBy("host", "g").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    above = cut(shapes.withColumn("k", F.explode(F.sequence(F.lit(0), F.size(labels) - 1))).withColumn("scope", scope))
    sums = above.groupBy("k", "scope", "g").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    chain = spread_join(above.select("host", "g", "k", "scope"), sums, ["k", "scope", "g"]).groupBy("host", "g").agg(F.sort_array(F.collect_list(F.struct("k", "l", "b"))).alias("chain"))
    down = lambda p: prior + carry * (p - prior)
    smooth = lambda b, l, p: (b + strength * p) / (l + strength)
    p = F.aggregate("chain", F.lit(None).cast("double"), lambda p, e: smooth(e["b"], e["l"], F.coalesce(down(p), F.lit(prior))))
    chain = chain.select("host", "g", p.alias("p"))
    pairs = cut(tree.select("host", "t", "g").distinct())
    both = spread_join(spread_join(pairs, mine, ["host", "t"]), chain, ["host", "g"], hot=hot_keys(pairs, ["host", "g"]))
    return both.select("host", "t", "g", smooth(F.col("blocked"), F.col("labelled"), down(F.col("p"))).alias("purity"))
