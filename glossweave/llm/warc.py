"""WARC: resolution of not-modified revisits.

A revisit record (HTTP 304) has no body of its own. It is resolved by an as-of
join on the canonical URL to the latest earlier full response; validators decide
whether that response is the one meant (RFC 9110, 13: entity tags compared
weakly, else Last-Modified, else the payload digest), and the headers that a 304
may update are merged into the stored ones (RFC 9111, 3.2).

The join is a window in order of time. A URL with very many captures is cut into
time slices at quantiles of its own dates; what a slice starts with is the last
response of the slices before it. Only ids, validators and headers go through
the window; bodies stay where they are and are joined by id at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields that describe the stored body and are never taken from a 304 (RFC 9110, 15.4.5; RFC 9111, 3.2).
KEPT_FIELDS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade", "set-cookie")
HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, www or m label, default port, fragment, tracking parameters and final slash; other parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www[0-9]*|m)\.", ""), r"(\.|:80|:443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(ref|fbclid|gclid|utm_[a-z]+|sessionid|sid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header(headers: str, name: str) -> Column:
    """The first value of a field, by name in any case."""
    return F.get(F.filter(F.col(headers), lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored fields, those named by the update replaced, the body's own kept; sorted by name, then value."""
    allowed = F.filter(update, lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(*KEPT_FIELDS))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    rest = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return F.array_sort(F.concat(rest, allowed), lambda a, b: F.when(F.lower(a["name"]) < F.lower(b["name"]), -1).when(F.lower(a["name"]) > F.lower(b["name"]), 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))


def resolve_revisits(records: DataFrame, hot: int = 4096) -> DataFrame:
    """One row a revisit of ``records(record_id, url, date, status, headers, payload, digest)``.

    Columns: ``record_id, canonical, resolved_id, verdict, headers, payload``. Full
    responses have status 200 and a payload, revisits status 304. Earlier means
    smaller (date, record_id). Verdicts: ``etag``, ``last-modified`` or ``digest``
    (what has confirmed the response), ``unchecked`` (nothing to compare),
    ``mismatch`` (a validator differs: neither headers nor payload are given), and
    ``missing`` (no earlier full response, or a null url or date). Null headers
    count as none, a null record_id sorts first and is never joined to a payload.
    Repeated revisits are resolved each; repeated responses count once, and of
    different responses with one record_id the payload is the earliest one's, then
    the smallest. Texts of any length pass whole. Other columns are ignored.
    """
    full = (F.col("status") == 200) & F.col("payload").isNotNull()
    r = records.where(full | (F.col("status") == 304))
    r = r.select("record_id", "date", canonical_url(F.col("url")).alias("canonical"), (F.col("status") == 304).alias("revisit"), F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "digest")
    known = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    placed = r.where(known)
    busy = placed.groupBy("canonical").agg(F.count("*").alias("n"), F.percentile_approx("date", [k / 128 for k in range(1, 128)], 2000).alias("bounds")).where(F.col("n") > hot).select("canonical", "bounds")
    placed = placed.join(busy, "canonical", "left").withColumn("slice", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("date"))), F.lit(0))).drop("bounds")
    placed = placed.withColumn("slice", F.greatest("slice", F.lit(0)))
    stored = F.when(~F.col("revisit"), F.struct("record_id", "date", "headers", "digest"))
    by_time = W.partitionBy("canonical", "slice").orderBy("date", "record_id").rowsBetween(W.unboundedPreceding, -1)
    within = placed.withColumn("stored", F.last(stored, ignorenulls=True).over(by_time)).where("revisit")
    ends = placed.where("not revisit").groupBy("canonical", "slice").agg(F.max_by(F.struct("record_id", "date", "headers", "digest"), F.struct("date", "record_id")).alias("end"))
    starts = placed.select("canonical", "slice").distinct().join(ends, ["canonical", "slice"], "left")
    starts = starts.withColumn("before", F.last("end", ignorenulls=True).over(W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).select("canonical", "slice", "before")
    found = within.join(starts, ["canonical", "slice"], "left").withColumn("s", F.coalesce("stored", "before")).select("record_id", "canonical", "headers", "digest", "s")
    lost = r.where(~known & F.col("revisit")).select("record_id", "canonical", "headers", "digest")
    found = found.unionByName(lost, allowMissingColumns=True)
    found = found.withColumn("old", F.col("s.headers"))
    checks = {"etag": (_weak(header("headers", "etag")), _weak(header("old", "etag"))), "last-modified": (F.trim(header("headers", "last-modified")), F.trim(header("old", "last-modified"))), "digest": (F.col("digest"), F.col("s.digest"))}
    verdict = F.when(F.col("s").isNull(), "missing")
    for name, (new, old) in checks.items():
        both = new.isNotNull() & old.isNotNull()
        verdict = verdict.when(both & (new == old), name).when(both, "mismatch")
    found = found.withColumn("verdict", verdict.otherwise("unchecked"))
    good = ~F.col("verdict").isin("missing", "mismatch")
    found = found.select("record_id", "canonical", F.col("s.record_id").alias("resolved_id"), "verdict", F.when(good, merge_headers(F.col("old"), F.col("headers"))).alias("headers"), F.when(good, F.col("s.record_id")).alias("__body"))
    # one body a record_id: the earliest, then the smallest, if several responses share it
    bodies = records.where(full).groupBy(F.col("record_id").alias("__body")).agg(F.min(F.struct(F.col("date").isNull().alias("undated"), "date", "payload"))["payload"].alias("payload"))
    return found.join(bodies, "__body", "left").drop("__body")


def captures(pages: DataFrame) -> DataFrame:
    """The records that a crawl of ``pages(page_id, url, html)`` leaves: a full response each, and later a 304, of which every fifth names another version."""
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("date"), F.lit(200).alias("status"),
        F.array(field("Content-Type", F.lit("text/html")), field("Content-Length", F.octet_length("html")), field("ETag", etag), field("Cache-Control", F.lit("max-age=60"))).alias("headers"), F.col("html").alias("payload"), F.sha2("html", 256).alias("digest"),
    )
    tag = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).when(F.col("page_id") % 5 == 1, F.concat(F.lit("W/"), etag)).otherwise(etag)
    later = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://"), F.lit("#again")).alias("url"), (F.col("page_id") * 10 + 5 + F.col("page_id") % 4 * 100_000).alias("date"), F.lit(304).alias("status"),
        F.array(field("etag", tag), field("Cache-Control", F.lit("max-age=120")), field("Content-Length", F.lit("0"))).alias("headers"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(later)


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of ``captures`` of all pages, with merged headers as text and a digest of the payload (null where none is given)."""
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit("="), h["value"])), ";")
    return out.select("record_id", "canonical", "resolved_id", "verdict", listed.alias("merged"), F.sha2("payload", 256).alias("payload_sha256"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM pages
), c AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(x, '^([^/?]*)', 1), '^[^@]*@', '')), '^(www[0-9]*|m)\.', ''), '(\.|:80|:443)$', '')
    || regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(x, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|fbclid|gclid|utm_[a-z]+|sessionid|sid)(=|$)'))) AS q
  FROM u
), k AS (
  SELECT page_id, html, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c
), revisit AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, page_id * 10 + 5 + page_id % 4 * 100000 AS d,
    CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE '"' || md5(html) || '"' END AS tag,
    CASE WHEN page_id % 5 = 1 THEN 'W/' ELSE '' END AS weak
  FROM k
), best AS (
  SELECT r.*, s.page_id AS sp, s.html FROM revisit r ASOF LEFT JOIN k s ON r.canonical = s.canonical AND r.d > s.page_id * 10
)
SELECT record_id, canonical, sp * 2 AS resolved_id,
  CASE WHEN sp IS NULL THEN 'missing' WHEN tag = '"' || md5(html) || '"' THEN 'etag' ELSE 'mismatch' END AS verdict,
  CASE WHEN tag = '"' || md5(html) || '"' THEN
    'cache-control=max-age=120;content-length=' || strlen(html) || ';content-type=text/html;etag=' || weak || tag END AS merged,
  CASE WHEN tag = '"' || md5(html) || '"' THEN sha256(html) END AS payload_sha256
FROM best
"""
