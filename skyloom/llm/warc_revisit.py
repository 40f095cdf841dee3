"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A revisit record with profile server-not-modified has no body; it stands for the latest full response of the
same canonical URL that was captured strictly before it. Its validators are checked against that response
(entity tag first, else the last-modified date); if they agree, the response's headers are merged with those that
a 304 answer may update. Everything is DataFrame functions.

The as-of join is two-level, so a URL may hold any share of the records: time is cut into slots of about equally many records, a
window finds the latest response inside (URL, slot), and each slot's last response is carried to the later
slots of its URL. A task sees one slot of a URL, or one row for each of its slots, never all of its records.

Nulls: a record without a URL, with one that isn't scheme://host, or without a time resolves to nothing (``orphan``). A revisit without validators, or whose
response lacks them, is a ``mismatch``. Of responses at one time the one with the largest record id wins.
Repeated records are resolved each for itself. An empty table gives an empty result; extra columns of any name aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Records of a time slot, on average, and quantiles of time that bound slots; beyond these, each part is cut evenly.
SLOT_RECORDS, QUANTILES = 20_000, 256

# Headers that a 304 answer may update (RFC 9110, 15.4.5), and query parameters that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sid)(=.*)?$"

_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and usual ports, path without a trailing slash, sorted query without tracking; no scheme, no fragment. Null for what isn't scheme://host."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(part(2), r"/+$", "")
    query = F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))
    return F.when(url.rlike(_PARTS), whole)


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted ones of the update; null headers are none."""
    stored, update = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (stored, update))
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def _slot(ts: Column, borders: list, cuts: int) -> Column:
    """Number of the time slot: between two borders, cut evenly into ``cuts``. Later times never have smaller numbers."""
    parts = list(enumerate(zip(borders, borders[1:] or borders, strict=False)))
    inner = lambda low, high: F.least(F.greatest(F.floor((ts - F.lit(low)) * cuts / max(1, high - low + 1)), F.lit(0)), F.lit(cuts - 1))
    number = lambda k, low, high: F.lit(k * cuts) + inner(low, high)
    out = F
    for k, (low, high) in reversed(parts[1:]):
        out = out.when(ts >= F.lit(low), number(k, low, high))
    first = number(0, *parts[0][1])
    return (first if out is F else out.otherwise(first)).cast("long")


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit of records (rec, kind, url, ts, etag, last_modified, headers): its response, status and merged headers."""
    found = records.select("rec", "kind", canonical_url(F.col("url")).alias("url"), "ts", "etag", "last_modified", "headers")
    sound = F.col("url").isNotNull() & F.col("ts").isNotNull()
    lost = found.filter(~sound & (F.col("kind") != "response"))
    found = found.filter(sound)
    n = found.count()
    parts = min(QUANTILES, common.buckets(n, SLOT_RECORDS, 4))
    borders = found.agg(F.percentile_approx("ts", [k / parts for k in range(parts + 1)])).first()[0] or [0, 0]
    found = found.withColumn("slot", _slot(F.col("ts"), sorted(set(borders)), common.buckets(n, SLOT_RECORDS * parts)))
    full = F.col("kind") == "response"
    body = F.struct("ts", "rec", "etag", "last_modified", "headers")
    found = found.withColumn("body", F.when(full, body))
    inside = Window.partitionBy("url", "slot").orderBy("ts", full.cast("int"), "rec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("own", F.last("body", ignorenulls=True).over(inside)).filter(~full)
    ends = found.filter(full).groupBy("url", "slot").agg(F.max_by("body", F.struct("ts", "rec")).alias("end"))
    # every slot of a URL that holds a revisit or ends with a response, in order
    asked = placed.filter(F.col("own").isNull()).select("url", "slot").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    before = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.unionByName(asked).groupBy("url", "slot").agg(F.max_by("end", F.col("end").isNotNull()).alias("end"))
    carried = steps.withColumn("carry", F.last("end", ignorenulls=True).over(before)).filter("carry is not null").select("url", "slot", "carry")
    out = placed.join(carried, ["url", "slot"], "left").withColumn("r", F.coalesce("own", "carry"))
    agree = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("etag") == F.col("r.etag")).otherwise(F.coalesce(F.col("last_modified") == F.col("r.last_modified"), F.lit(False)))
    status = F.when(F.col("r").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    out = out.withColumn("status", status)
    merged = F.when(F.col("status") == "resolved", merged_headers(F.col("r.headers"), F.col("headers")))
    out = out.select("rec", "url", "ts", "status", F.when(F.col("status") == "resolved", F.col("r.rec")).alias("response_rec"), merged.alias("headers"))
    return out.unionByName(lost.select("rec", "url", "ts", F.lit("orphan").alias("status")), allowMissingColumns=True)


def header_lines(headers: Column) -> Column:
    """name: value lines, by name."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda x: F.concat_ws(": ", x["key"], x["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records of pages: a full response each, a revisit by entity tag, and one by date (some changed, some too early)."""
    ts = (F.col("page_id") * 7919 % 1000003).cast("long")
    size = F.length(F.coalesce("html", F.lit("")))
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    head = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    text = lambda c: c.cast("string")
    one = lambda no, kind, url, at, etag, modified, headers: F.struct((F.col("page_id") * 3 + no).alias("rec"), F.lit(kind).alias("kind"), url.alias("url"), at.cast("long").alias("ts"), etag.alias("etag"), modified.cast("long").alias("last_modified"), headers.alias("headers"))
    late = F.when(size % 5 == 0, ts - 50_000).otherwise(ts + 7200)
    none = F.lit(None).cast("string")
    records = F.array(
        one(0, "response", F.col("url"), ts, tag, ts - 86_400, head("content-type", "text/html", "content-length", text(size), "etag", tag, "date", text(ts))),
        one(1, "revisit", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")), ts + 3600, tag, F.lit(None), head("content-length", "0", "etag", tag, "date", text(ts + 3600), "expires", text(ts + 7200))),
        one(2, "revisit", F.col("url"), late, none, ts - 86_400 + F.when(size % 7 == 0, 1).otherwise(0), head("date", text(late), "cache-control", "max-age=60", "connection", "close")),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = common.store(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), "captures")
    return resolve(records).withColumn("headers", header_lines(F.col("headers")))


SQL3 = r"""
WITH p AS (SELECT page_id, url, page_id * 7919 % 1000003 AS t, length(coalesce(html, '')) AS n, md5(coalesce(html, '')) AS tag FROM pages),
rec AS (
  SELECT page_id * 3 AS rec, 'response' AS kind, url, t AS ts, tag AS etag, t - 86400 AS lm FROM p
  UNION ALL SELECT page_id * 3 + 1, 'revisit', regexp_replace(url, '#.*$', '') || '#again', t + 3600, tag, NULL FROM p
  UNION ALL SELECT page_id * 3 + 2, 'revisit', url, CASE WHEN n % 5 = 0 THEN t - 50000 ELSE t + 7200 END, NULL, t - 86400 + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END FROM p
),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 2), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 3), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sid)(=.*)?$'))) AS q
  FROM rec
),
c AS (SELECT rec, kind, ts, etag, lm, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url FROM parts),
latest AS (
  SELECT v.rec, v.url, v.ts, v.etag, v.lm, max(struct_pack(ts := r.ts, rec := r.rec, etag := r.etag, lm := r.lm)) AS r
  FROM c v LEFT JOIN c r ON r.kind = 'response' AND r.url = v.url AND r.ts < v.ts
  WHERE v.kind = 'revisit' GROUP BY ALL
),
judged AS (
  SELECT *, CASE WHEN r.rec IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN etag = r.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN lm = r.lm THEN 'resolved' ELSE 'mismatch' END AS status
  FROM latest
)
SELECT j.rec, j.url, j.ts, status, CASE WHEN status = 'resolved' THEN j.r.rec END AS response_rec,
  CASE WHEN status = 'resolved' THEN
    CASE WHEN j.rec % 3 = 1
      THEN 'content-length: ' || p.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || j.ts || chr(10) || 'etag: ' || j.etag || chr(10) || 'expires: ' || (j.ts + 3600)
      ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: ' || p.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || j.ts || chr(10) || 'etag: ' || j.r.etag END
  END AS headers
FROM judged j LEFT JOIN p ON p.page_id * 3 = j.r.rec
"""
