"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import table

#: Header fields of a 304 response that replace those of the stored response (HTTP semantics and caching).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that track visits and do not select content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid"
#: Seconds of a URL's history that one group holds at most.
SPAN = 86_400


def canonical_url(url: str | Column) -> Column:
    """Canonical form: no scheme, lower-case host without ``www.`` and default port, no fragment, sorted parameters
    without trackers, no slash at the end. What is no absolute URL is trimmed and kept; NULL stays NULL."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    whole = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, whole, 2)), r"^[^@]*@", ""), r"(:80|:443)$|\.(?=:|$)", "")
    path = F.regexp_replace(F.regexp_extract(u, whole, 3), r"/+$", "")
    params = F.filter(F.array_sort(F.split(F.substring(F.regexp_extract(u, whole, 4), 2, 1 << 30), "&")), lambda p: (p != "") & ~p.rlike(rf"^(?i)({TRACKING})(=|$)"))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(u.rlike(whole), F.concat(F.regexp_replace(host, r"^www\.", ""), path, query)).otherwise(u)


def _merge(stored: Column, new: Column) -> Column:
    """The stored header fields (names in lower case), with the permitted ones of the newer response."""
    fresh = F.filter(new, lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(fresh, lambda e: e["key"])
    kept = F.filter(stored, lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.concat(kept, fresh))


def _fields(headers: str) -> Column:
    """Header fields as sorted (name, value) pairs, names in lower case, one of each."""
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    pairs = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.col(headers), F.array_min(F.filter(F.map_keys(headers), lambda x: F.lower(x) == k))).alias("value")))
    return F.coalesce(F.array_sort(pairs), F.array().cast("array<struct<key: string, value: string>>"))


def _value(fields: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(fields, lambda e: e["key"] == name), lambda e: e["value"]), F.lit(0))


def resolve_revisits(records: DataFrame, *, span: int = SPAN, bodies: DataFrame | None = None) -> DataFrame:
    """Resolves every not-modified revisit of ``records (record_id, kind, uri, at, status, headers, digest)``.

    A full response is a row of kind ``response`` with status 200; a revisit is a row of kind ``revisit``. One row comes
    back per revisit: ``record_id, url`` (canonical), ``at, outcome, response_id, response_digest, headers``. The stored
    response is the latest one of the same canonical URL at a strictly earlier time (of several at that time, the one
    with the largest record id). Outcomes: ``resolved``; ``no_response`` (none is earlier, or URL or time is NULL);
    ``mismatch`` (ETags by weak comparison, or without a pair of them the Last-Modified values, differ); ``unvalidated``
    (no validator in common). Only resolved rows carry the response and the merged headers: the stored fields, with the
    permitted ones of the revisit. With ``bodies (record_id, body)`` resolved rows get the response's body.

    Repeated rows are resolved as often as they come; an empty table gives none; further columns are ignored.

    Times are cut into spans: within (URL, span) a window looks back, and before the span the last response of earlier
    spans is carried forward from one pre-aggregated row per (URL, span). So a URL with a third of all records is split by
    time. No body is shuffled unless asked for.
    """
    r = records.select("record_id", "kind", canonical_url("uri").alias("url"), F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.col("at"), _fields("headers").alias("fields"), "digest", "status")
    r = r.withColumn("span", F.floor(F.col("t") / (span * 1_000_000)))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    stored = F.when(full & F.col("url").isNotNull(), F.struct("t", "record_id", "digest", "fields"))
    r = r.withColumn("stored", stored).where(F.col("stored").isNotNull() | (F.col("kind") == "revisit"))
    known = r.where("url IS NOT NULL AND t IS NOT NULL")
    lost = r.where("kind = 'revisit' AND (url IS NULL OR t IS NULL)").withColumn("found", F.lit(None).cast(r.schema["stored"].dataType))

    per_span = known.groupBy("url", "span").agg(F.max("stored").alias("last"))
    earlier = F.last("last", ignorenulls=True).over(W.partitionBy("url").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    carried = per_span.select("url", "span", earlier.alias("carried"))
    inside = F.max("stored").over(W.partitionBy("url", "span").orderBy("t").rangeBetween(W.unboundedPreceding, -1))
    found = known.withColumn("inside", inside).where("kind = 'revisit'").join(carried, ["url", "span"])
    found = found.withColumn("found", F.coalesce("inside", "carried")).drop("inside", "carried")

    both = found.unionByName(lost.select(*found.columns))
    weak = lambda c: F.regexp_replace(c, r"^\s*W/", "")
    pairs = [(weak(_value(F.col("fields"), "etag")), weak(_value(F.col("found.fields"), "etag"))), (_value(F.col("fields"), "last-modified"), _value(F.col("found.fields"), "last-modified"))]
    same = F.coalesce(*(a == b for a, b in pairs))
    outcome = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated")
    out = both.withColumn("outcome", outcome)
    hit = F.col("outcome") == "resolved"
    out = out.select(
        "record_id", "url", "at", "outcome", F.when(hit, F.col("found.record_id")).alias("response_id"), F.when(hit, F.col("found.digest")).alias("response_digest"), F.when(hit, _merge(F.col("found.fields"), F.col("fields"))).alias("headers")
    )
    if bodies is not None:
        out = out.join(bodies.select(F.col("record_id").alias("response_id"), "body"), "response_id", "left")
    return out


#: Fixed: the first page's time in the records made from ``pages``.
START = "2024-01-01 00:00:00"


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records made from ``pages``: each page as a full response, and two later visits that found it unchanged.

    The visits ask for another spelling of the URL; some carry a changed validator, only a date, or none, and some are
    older than the response. All that follows from ``page_id``.
    """
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), etag.alias("etag"))
    seconds = F.expr("page_id * 7919 % 2592000")

    def visit(number: int, kind: str, uri: Column, at: Column, tag: Column, modified: Column) -> DataFrame:
        fields = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {
            "ETag": tag, "Last-Modified": modified, "Content-Type": F.lit("text/html") if number == 0 else F.lit("text/plain"),
            "Cache-Control": F.lit(f"max-age={number}"), "X-Visit": F.lit(str(number)),
        }.items())), lambda e: e["value"].isNotNull()))
        when = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + at)
        return p.select((F.col("page_id") * 3 + number).alias("record_id"), F.lit(kind).alias("kind"), uri.alias("uri"), when.alias("at"), F.lit(200 if number == 0 else 304).alias("status"), fields.alias("headers"), F.when(F.lit(number == 0), F.col("digest")).alias("digest"))

    modified = F.concat(F.lit("day "), F.expr("page_id % 28").cast("string"))
    nothing = F.lit(None).cast("string")
    key = F.col("page_id")
    first = visit(0, "response", F.col("url"), seconds, F.col("etag"), modified)
    second = visit(1, "revisit", F.concat(F.col("url"), F.lit("#again")), seconds + F.when(key % 11 == 0, -60).otherwise(3600), F.when(key % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("etag"))), nothing)
    third = visit(2, "revisit", F.regexp_replace("url", "^http:", "HTTP:"), seconds + 864000, nothing, F.when(key % 7 != 0, modified))
    return first.unionByName(second).unionByName(third)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, response and merged headers of every revisit among the records made from all pages."""
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    kept = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return out.select("record_id", "url", "outcome", "response_id", "response_digest", kept.alias("headers"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag,
         epoch(TIMESTAMP '{START}') + page_id * 7919 % 2592000 AS t, 'day ' || CAST(page_id % 28 AS VARCHAR) AS modified FROM pages),
raw AS (
  SELECT page_id * 3 AS record_id, 0 AS n, url AS uri, t, etag, modified, digest FROM p
  UNION ALL SELECT page_id * 3 + 1, 1, url || '#again', t + CASE WHEN page_id % 11 = 0 THEN -60 ELSE 3600 END,
                   CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE 'W/' || etag END, NULL, NULL FROM p
  UNION ALL SELECT page_id * 3 + 2, 2, regexp_replace(url, '^http:', 'HTTP:'), t + 864000, NULL, CASE WHEN page_id % 7 <> 0 THEN modified END, NULL FROM p),
cut AS (
  SELECT *, lower(regexp_extract(uri, '^(?i)https?://([^/?#]*)', 1)) AS host, regexp_extract(uri, '^(?i)https?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(uri, '^[^?#]*[?]([^#]*)', 1) AS query FROM raw),
r AS (
  SELECT record_id, n, t, etag, modified, digest,
         regexp_replace(regexp_replace(host, '(:80|:443)$', ''), '^www[.]', '') || regexp_replace(path, '/+$', '') ||
         CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url
  FROM (SELECT *, list_filter(list_sort(string_split(query, '&')), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)({TRACKING})(=|$)')) AS params FROM cut)),
best AS (
  SELECT v.record_id, max_by(f.record_id, row(f.t, f.record_id)) AS found
  FROM r v JOIN r f ON f.url = v.url AND f.n = 0 AND v.n > 0 AND f.t < v.t GROUP BY v.record_id),
j AS (
  SELECT v.record_id, v.url, v.n, v.etag, v.modified, f.record_id AS fid, f.digest AS fdigest, f.etag AS fetag, f.modified AS fmodified,
         coalesce(regexp_replace(v.etag, '^W/', '') = f.etag, v.modified = f.modified) AS same
  FROM r v LEFT JOIN best b USING (record_id) LEFT JOIN r f ON f.record_id = b.found WHERE v.n > 0)
SELECT record_id, url, CASE WHEN fid IS NULL THEN 'no_response' WHEN same THEN 'resolved' WHEN NOT same THEN 'mismatch' ELSE 'unvalidated' END AS outcome,
       CASE WHEN same THEN fid END AS response_id, CASE WHEN same THEN fdigest END AS response_digest,
       CASE WHEN same THEN 'cache-control=max-age=' || n || '; content-type=text/html; etag=' || coalesce(etag, fetag) || '; last-modified=' || coalesce(modified, fmodified) || '; x-visit=0' END AS headers
FROM j
"""
