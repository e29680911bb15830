"""WARC: resolve not-modified revisits to the latest earlier full response of the same canonical URL.

A crawler that sends If-None-Match or If-Modified-Since may get 304 and stores a revisit record: headers, no body.
Each revisit is joined, as of its time, to the latest earlier full response of its canonical URL. The validators
must agree: equal entity tags (strong or weak form) if both have one, else equal Last-Modified. Then the stored
response's headers are brought up to date with those headers of the 304 that a 304 may carry.

Records: record_id, url, at (order of capture), kind ('response' or 'revisit'), headers map<string,string> with
lower-case names. The as-of join runs in two steps, so that one URL with a large share of all records is dealt over
many tasks: latest response within (URL, span of time), then the latest over the spans before.

Defined cases: a record with a null or empty URL, or no time, resolves to nothing ('no target'); records at one time
are ordered by record_id; repeated rows resolve alike; a revisit before any response has 'no target', one with
other validators is a 'mismatch', one without any validator 'no validator'; an empty table gives an empty result;
other columns pass through untouched, whatever their names, but those with the name of an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import read

#: fixed values: headers that a 304 response may bring up to date (RFC 9110, 15.4.5, and RFC 9111, 3.2)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
ADDED = ("canonical_url", "target_id", "status", "merged_headers")
#: spans into which the time of one URL is cut
SPAN = 1024


def canonical_url(url: Column) -> Column:
    """Lower-case host, no 'www.', no default port, fragment or utm_ parameters, no trailing slash; http and https are one. All else tells resources apart."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    rest = F.regexp_replace(plain, "^[A-Za-z]+://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, "\\?.*$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, "\\?(.*)$", 1), "(^|&)utm_[a-z]+=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def bare_tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED, span: int = SPAN) -> DataFrame:
    """Adds canonical_url, target_id, status ('response', 'resolved', 'mismatch', 'no validator', 'no target', 'other') and merged_headers.

    Bodies need not move: leave them out of records and fetch them by target_id afterwards (attach).
    """
    # the caller's columns travel in one struct, so that no working column can have the name of one
    kept = [c for c in records.columns if c.lower() not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = records.select(row.alias("row"), canonical_url(F.col("url")).alias("canon"))
    at, record_id = F.col("row.at"), F.col("row.record_id")
    joinable = F.coalesce(F.col("canon") != "", F.lit(False)) & at.isNotNull() & record_id.isNotNull()
    is_full = F.coalesce(F.col("row.kind") == "response", F.lit(False))
    known = rows.filter(joinable).select("row", "canon", F.floor(at / span).alias("span"), F.when(is_full, F.struct(at.alias("at"), record_id.alias("id"))).alias("full"))
    inside = Window.partitionBy("canon", "span").orderBy("row.at", "row.record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last("full", ignorenulls=True).over(inside))
    # one row a span: the last response of the spans before
    spans = known.groupBy("canon", "span").agg(F.max("full").alias("latest"))
    earlier = Window.partitionBy("canon").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("canon", "span", F.last("latest", ignorenulls=True).over(earlier).alias("before"))
    found = near.join(spans, ["canon", "span"]).select("row", "canon", F.when(F.col("row.kind") == "revisit", F.coalesce("near", "before")["id"]).alias("target"))
    found = found.unionByName(rows.filter(~joinable).withColumn("target", F.lit(None).cast(records.schema["record_id"].dataType)))
    full = rows.filter(joinable & is_full).groupBy(record_id.alias("target")).agg(F.first("row.headers").alias("stored"))
    # rows without a target would all meet under one null key
    out = found.filter("target is not null").join(full, "target", "left")
    out = out.unionByName(found.filter("target is null"), allowMissingColumns=True)
    headers, stored, kind = F.col("row.headers"), F.col("stored"), F.col("row.kind")
    own_tag, stored_tag = bare_tag(headers), bare_tag(stored)
    dates = headers["last-modified"], stored["last-modified"]
    tags = own_tag.isNotNull() & stored_tag.isNotNull()
    both_dates = dates[0].isNotNull() & dates[1].isNotNull()
    agrees = F.when(tags, own_tag == stored_tag).when(both_dates, dates[0] == dates[1])
    status = (
        F.when(kind == "response", "response")
        .when(F.coalesce(kind != "revisit", F.lit(True)), "other")
        .when(F.col("target").isNull(), "no target")
        .when(agrees.isNull(), "no validator")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    out = out.withColumn("newer", F.map_filter(headers, lambda k, v: k.isin(*permitted))).withColumn("status", status)
    older = F.map_filter(stored, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("newer"), k), F.lit(False)))
    out = out.select("row", "canon", "target", "status", F.when(F.col("status") == "resolved", F.map_concat(older, "newer")).alias("merged"))
    added = [F.col(c).alias(name) for c, name in zip(("canon", "target", "status", "merged"), ADDED, strict=True)]
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *added)


def attach(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds the stored body (column body of bodies, by record_id) to each resolved revisit; others get null. A column body of resolved is replaced."""
    kept = [c for c in resolved.columns if c.lower() != "body"]
    rows = resolved.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.when(F.col("status") == "resolved", F.col("target_id")).alias("target"))
    full = bodies.groupBy(F.col("record_id").alias("target")).agg(F.first("body").alias("body"))
    # rows that want no body would all meet under one null key
    met = rows.filter("target is not null").join(full, "target", "left").select("row", "body")
    return met.unionByName(rows.filter("target is null").select("row"), allowMissingColumns=True).select(*[F.col("row")[c].alias(c) for c in kept], "body")


def captures(pages: DataFrame) -> DataFrame:
    """Two records of each page, for want of WARC files among the tables: its response, and a later revisit under another spelling of the URL.

    Every seventh revisit brings another entity tag, every eleventh none but a date, every thirteenth no validator.
    """
    pid = F.col("page_id")
    etag, date = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), (pid % 365).cast("string"))
    base = pages.select("page_id", "url", etag.alias("etag"), date.alias("date"), F.length("html").cast("string").alias("length"))
    text = lambda x: F.lit(x)
    response = base.select(
        (2 * pid).alias("record_id"), "url", (10 * pid).alias("at"), text("response").alias("kind"),
        F.create_map(text("etag"), "etag", text("last-modified"), "date", text("content-length"), "length", text("content-type"), text("text/html"), text("cache-control"), text("max-age=60")).alias("headers"),
    )
    own_tag = F.when(pid % 13 == 0, None).when(pid % 11 == 0, None).when(pid % 7 == 0, text('"other"')).otherwise(F.concat(text("W/"), "etag"))
    headers = F.create_map(text("etag"), own_tag, text("last-modified"), F.when(pid % 13 == 0, None).otherwise(F.col("date")), text("content-length"), text("0"), text("cache-control"), text("max-age=99"), text("expires"), F.concat(text("in "), (pid % 30).cast("string")))
    revisit = base.select(
        (2 * pid + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), text("#again")).alias("url"), (10 * pid + 10 * (pid % 97) + 5).alias("at"), text("revisit").alias("kind"),
        F.map_filter(headers, lambda k, v: v.isNotNull()).alias("headers"),
    )
    return response.unionByName(revisit)


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", F.col("at").alias("captured"), "canonical_url", "target_id", "status", merged.alias("merged_headers"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, url, '"' || md5(html) || '"' AS etag, 'day ' || (page_id % 365) AS day, CAST(length(html) AS VARCHAR) AS len FROM pages
), rec AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS captured, 'response' AS kind, etag AS tag, day, len, NULL AS expires FROM base
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '#.*$', '') || '#again', 10 * page_id + 10 * (page_id % 97) + 5, 'revisit',
         CASE WHEN page_id % 13 = 0 OR page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/' || etag END,
         CASE WHEN page_id % 13 = 0 THEN NULL ELSE day END, '0', 'in ' || (page_id % 30) FROM base
), plain AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM rec
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(u, '^[A-Za-z]+://[^/?]*', '') AS rest FROM plain
), canon AS (
  SELECT *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)utm_[a-z]+=[^&]*', '', 'g'), '^&', '') AS query FROM parts
), named AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM canon
), asof_ AS (
  SELECT *, CASE WHEN kind = 'revisit' THEN last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (
      PARTITION BY canonical_url ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target_id FROM named
), joined AS (
  SELECT a.record_id, a.captured, a.canonical_url, a.target_id, a.kind, a.tag, a.day, a.expires, b.tag AS btag, b.day AS bday, b.len AS blen,
         CASE WHEN a.tag IS NOT NULL AND b.tag IS NOT NULL THEN regexp_replace(a.tag, '^W/', '') = regexp_replace(b.tag, '^W/', '')
              WHEN a.day IS NOT NULL AND b.day IS NOT NULL THEN a.day = b.day END AS agrees
  FROM asof_ a LEFT JOIN asof_ b ON a.target_id = b.record_id AND b.kind = 'response'
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN target_id IS NULL THEN 'no target' WHEN agrees IS NULL THEN 'no validator'
                 WHEN agrees THEN 'resolved' ELSE 'mismatch' END AS status FROM joined
)
SELECT record_id, captured, canonical_url, target_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=99;content-length=' || blen || ';content-type=text/html;etag=' || coalesce(tag, btag)
            || ';expires=' || expires || ';last-modified=' || coalesce(day, bday) END AS merged_headers
FROM judged
"""
