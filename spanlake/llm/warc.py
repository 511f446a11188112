"""Resolution of WARC not-modified revisits against earlier full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import spread_join, stored

#: Headers that a 304 may renew on the stored response (RFC 9111 3.2 leaves the others alone).
RENEWABLE = ("cache-control", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, no tracking query, no trailing slash.

    Null stays null; text without `://` has no host, the rest holds for it as well.
    """
    u = F.regexp_replace(F.trim(url), "#(?s:.*)$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    head = F.regexp_replace(F.regexp_replace(F.lower(head), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])utm_[^&]*", "$1"), r"[?&]+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\?&+", "?"), "&&+", "&")
    return F.concat(head, F.regexp_replace(rest, "/$", ""))


def resolve_revisits(records: DataFrame, slice_width: int = 10_000, renewable: tuple[str, ...] = RENEWABLE) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    Takes record_id, url, ts (long), kind (`response` or `revisit`), etag, last_modified and headers
    (map of lower-case names); other columns are ignored. Returns a row for each revisit: record_id,
    url_key, ts, response_id, outcome and headers. Outcomes: `resolved`; `stale` where a validator
    that both sides carry differs (ETags compare weakly, without `W/`; the date counts only where an
    ETag is missing on a side); `unproven` where no validator is on both sides; `no_response` where
    no response with a non-null url came before. "Earlier" is by (ts, record_id), so records of one
    instant are ordered by id and repeated records by nothing else. Headers are the response's, with
    those in `renewable` renewed by the revisit, for `resolved` only; else null.

    A URL's records are split by time into slices of `slice_width`; each slice starts from the last
    response that a running maximum over slice summaries carries in, so a URL with a third of all
    records is spread over its slices; so are the revisits of one response, and those without any. Bodies don't move: take them by response_id.
    """
    base = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "headers")
    base = base.withColumn("slice", F.floor(F.col("ts") / slice_width))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    keyed = base.filter("url_key is not null and ts is not null")
    narrow = keyed.select("url_key", "slice", "ts", "record_id", "kind")

    sums = narrow.groupBy("url_key", "slice").agg(F.max(full).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("url_key", "slice", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("ts", "record_id", F.expr("kind = 'response'")).rowsBetween(Window.unboundedPreceding, -1)
    seen = narrow.withColumn("own", F.last(full, ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    seen = seen.join(carried, ["url_key", "slice"])
    found = seen.select(F.col("record_id").alias("id"), F.coalesce("own", "carried")["record_id"].alias("response_id"))

    tag = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    revisits = stored(base.filter("kind = 'revisit'").join(found.dropDuplicates(["id"]), F.col("record_id") == F.col("id"), "left").drop("id"))
    full_rows = base.filter("kind = 'response'").dropDuplicates(["record_id"])
    full_rows = full_rows.select(F.col("record_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers"))
    both = spread_join(revisits, full_rows, ["response_id"], "left")
    outcome = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), F.when(tag("etag") == tag("r_etag"), "resolved").otherwise("stale"))
        .when(F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull(), F.when(F.col("last_modified") == F.col("r_modified"), "resolved").otherwise("stale"))
        .otherwise("unproven")
    )
    mine = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    stored_ = F.coalesce("r_headers", F.create_map().cast("map<string,string>"))
    renewed = F.map_filter(mine, lambda k, v: k.isin(*renewable) & v.isNotNull())
    merged = F.map_concat(F.map_filter(stored_, lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    out = both.withColumn("outcome", outcome)
    return out.select("record_id", "url_key", "ts", "response_id", "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log made of `pages`: a full response for each page and revisits around it.

    Page p is fetched at 10p; its URL is asked for again at 10p + 5 and 10p + 40, where every
    seventh page has changed its ETag by the second time and every eleventh sends only a date; every
    fifth page was already asked for at 10p - 5.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    rec = lambda no, kind, ts, etag, date: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), ts.alias("ts"), etag.alias("etag"), date.alias("last_modified"))
    none, t = F.lit(None).cast("string"), F.col("page_id") * 10
    dated = F.col("page_id") % 11 == 0
    rows = F.array(
        rec(0, "response", t, F.when(~dated, F.col("digest")), day),
        rec(1, "revisit", t + 5, F.when(~dated, F.concat(F.lit("W/"), F.col("digest"))), F.when(dated, day)),
        rec(2, "revisit", t + 40, F.when(F.col("page_id") % 7 == 0, F.lit("changed")).otherwise(F.col("digest")), none),
        rec(3, "revisit", F.when(F.col("page_id") % 5 == 0, t - 5), F.col("digest"), none),
    )
    out = p.select("page_id", "url", "digest", F.explode(rows).alias("r")).filter("r.ts is not null")
    headers = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("date").alias("k"), F.concat(F.lit("t"), F.col("r.ts")).alias("v")),
                F.struct(F.lit("content-type").alias("k"), F.when(F.col("r.no") == 0, "text/html").otherwise("none").alias("v")),
                F.struct(F.lit("etag").alias("k"), F.col("r.etag").alias("v")),
            ),
            lambda e: e["v"].isNotNull(),
        )
    )
    return out.select((F.col("page_id") * 4 + F.col("r.no")).alias("record_id"), "url", "r.ts", "r.kind", "r.etag", "r.last_modified", headers.alias("headers"))
