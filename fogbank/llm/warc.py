"""Not-modified revisits of web captures (operator 5).

A revisit record has no body: the server said that nothing changed. It is resolved to the latest earlier full
response with the same canonical URL. The revisit's validators are checked against that response (entity tags if both
have one, else modification dates), and the headers that a 304 may update are merged over the response's own.

The as-of join is two-level: time is cut into blocks; each (URL, block) aggregates its last response, which a short
window over the URL's blocks carries forward; inside a block a window finds the last response before each revisit.
So even a URL with a third of all captures is spread over the blocks.

Null URLs are never resolved; equal times are ordered response first, then by record id; repeated records each give a
row; a record of neither kind is ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogbank.llm.common import ascii_lower

BLOCKS = 256
# Header fields that a not-modified answer may update (public HTTP semantics).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that don't choose the resource.
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Host in lower case, no scheme, www, default port, fragment, tracking parameters or closing slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_extract(u, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", "")
    return F.concat(host, rest)


def resolve_revisits(records: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row per revisit: its original response, status, the original's digest and size, and merged headers.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, headers (map, lower-case
    names), digest, size. Other columns are ignored.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "headers", "digest", "size"
    )
    bounds = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    width = max(1, -(-((bounds.hi or 0) - (bounds.lo or 0) + 1) // blocks))
    is_full = F.col("kind") == "response"
    keyed = rows.withColumn("block", ((F.col("ts") - F.lit(bounds.lo or 0)) / width).cast("long")).withColumn(
        "full", F.when(is_full & F.col("canonical").isNotNull(), F.struct("record_id", "etag", "last_modified", "headers", "digest", "size"))
    )
    last = keyed.where(F.col("full").isNotNull()).groupBy("canonical", "block").agg(F.max_by("full", F.struct("ts", "record_id")).alias("carried"))
    # A URL has at most one row per block here. Blocks that only hold revisits look back as well.
    asked = keyed.where(~is_full & F.col("canonical").isNotNull()).select("canonical", "block").distinct()
    by_block = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        asked.join(last, ["canonical", "block"], "full")
        .withColumn("before", F.last("carried", True).over(by_block))
        .where(F.col("before").isNotNull())
        .select("canonical", "block", "before")
    )
    inside = Window.partitionBy("canonical", "block").orderBy("ts", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        keyed.withColumn("near", F.last("full", True).over(inside))
        .where(~is_full)
        .join(carry, ["canonical", "block"], "left")
        .withColumn("orig", F.when(F.col("canonical").isNotNull(), F.coalesce("near", "before")))
    )
    same = (
        F.when(F.col("etag").isNotNull() & F.col("orig.etag").isNotNull(), F.col("etag") == F.col("orig.etag"))
        .when(F.col("last_modified").isNotNull() & F.col("orig.last_modified").isNotNull(), F.col("last_modified") == F.col("orig.last_modified"))
        .otherwise(F.lit(False))
    )
    status = F.when(F.col("orig").isNull(), "missing").when(same, "resolved").otherwise("stale")
    ok = F.col("status") == "resolved"
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("orig.headers", none), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return found.withColumn("status", status).select(
        "record_id",
        "canonical",
        "status",
        F.when(ok, F.col("orig.record_id")).alias("original_id"),
        F.when(ok, F.col("orig.digest")).alias("digest"),
        F.when(ok, F.col("orig.size")).alias("size"),
        F.when(ok, F.map_concat(kept, fresh)).alias("headers"),
    )


#: A page is asked for again this many page ids later.
RECRAWL = 1000


def crawl_records(pages: DataFrame) -> DataFrame:
    """The captures that a crawl of pages would have stored: every page in full, and a later not-modified answer for it.

    The second visit carries the entity tag of the first, so it is stale where another page with the same canonical URL
    was stored in between.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    etag = F.md5(html.cast("binary"))
    base = pages.select(F.col("page_id").alias("record_id"), "url", etag.alias("etag"), F.octet_length(html).cast("long").alias("size"))
    full = base.select(
        "record_id", "url", (2 * F.col("record_id")).alias("ts"), F.lit("response").alias("kind"), "etag",
        F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("etag"), F.lit("date"), (2 * F.col("record_id")).cast("string")).alias("headers"),
        F.col("etag").alias("digest"), "size",
    )
    later = 2 * F.col("record_id") + 2 * RECRAWL + 1
    again = base.select(
        "record_id", "url", later.alias("ts"), F.lit("revisit").alias("kind"), "etag",
        F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), later.cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"),
    )
    return full.unionByName(again)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select(
        F.col("record_id").alias("page_id"), "canonical", "status", "original_id", "digest", "size", headers.alias("headers")
    )


_U = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract({_U}, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '')"
_REST = f"regexp_replace(regexp_replace({_U}, '^[^/?]*', ''), '([?&]){TRACKING}=[^&]*', '\\1', 'g')"
_REST = f"regexp_replace(regexp_replace({_REST}, '&&+', '&', 'g'), '[?]&', '?', 'g')"
_REST = f"regexp_replace(regexp_replace({_REST}, '[?&]+$', ''), '/+$', '')"
OP5_SQL = f"""WITH p AS (
  SELECT page_id, {_HOST} || {_REST} AS canonical, md5(coalesce(html, '')) AS etag,
    coalesce(octet_length(encode(html)), 0)::BIGINT AS size FROM pages),
r AS (SELECT *, 2 * page_id + {2 * RECRAWL + 1} AS ts FROM p),
f AS (SELECT page_id AS original_id, canonical, etag AS full_etag, size AS full_size, 2 * page_id AS ts FROM p),
j AS (SELECT r.*, f.original_id AS oid, f.full_etag, f.full_size FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.ts >= f.ts)
SELECT page_id, canonical,
  CASE WHEN oid IS NULL THEN 'missing' WHEN etag = full_etag THEN 'resolved' ELSE 'stale' END AS status,
  CASE WHEN etag = full_etag THEN oid END AS original_id,
  CASE WHEN etag = full_etag THEN full_etag END AS digest,
  CASE WHEN etag = full_etag THEN full_size END AS size,
  CASE WHEN etag = full_etag THEN 'cache-control=max-age=60;content-type=text/html;date=' || ts || ';etag=' || full_etag END AS headers
FROM j"""
