"""Not-modified revisits of WARC captures, resolved by an as-of join.

A revisit record (a 304 answer) has headers but no payload. It belongs to the latest earlier full
response (status 200) of the same canonical URL. The validators are then checked: entity tags by weak
comparison where both sides have one, else the last-modified dates, else the payload digests; without a
common validator the pair is ``unverified``. A resolved revisit takes the base's payload (its digest, length
and record id, so no payload moves) and its headers, updated by the permitted ones of the 304 answer:
hop-by-hop fields and those that describe a payload stay as stored.

The join is range-partitioned by (URL, time), so a URL with any share of the records is spread over
many tasks: a window finds the last response within a partition, and the last one of earlier partitions is
carried over by a table of one row for each URL and partition.

Canonical URL: scheme and fragment dropped, host in lower case without ``www.``, user or default port, one
trailing slash of the path dropped, query parameters sorted without ``utm_*``. What doesn't look like a URL is
its own key.

Defined results: earlier means strictly smaller ``ts``; of responses with one ``ts`` the largest record
id counts. A null URL or time is ``no_base``. Null headers count as none. Repeated records each get
their row. Empty tables give empty tables. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm import common as C

#: Fields that a 304 answer may not change (RFC 9110 and 9111).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
               "trailer", "transfer-encoding", "upgrade")

URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)([?][^#]*)?(#.*)?$"


def canonical_url(url: Column) -> Column:
    def part(i):
        return F.regexp_extract(url, URL_RE, i)

    host = F.regexp_replace(F.lower(part(3)), r"^www\.", "")
    port = F.when((part(4) == ":") | (part(4) == ":80") | (part(4) == ":443"), "").otherwise(part(4))
    path = F.regexp_replace(part(5), "/$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.substring(part(6), 2, 1 << 30), "&"),
                                               lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(url.rlike(URL_RE), F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
                                              )).otherwise(url)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts (long), kind (response or revisit), status, headers (map with lower-case
    names), payload_digest, payload_length. One row a revisit."""
    empty = F.create_map().cast("map<string,string>")
    placed = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), (F.col("kind") == "revisit").alias("revisit"),
        F.coalesce("headers", empty).alias("headers"), "payload_digest", "payload_length").where("full or revisit")
    placed = C.stored(placed.repartitionByRange("url_key", "ts").withColumn("part", F.spark_partition_id()), "captures")
    response = F.struct("ts", "record_id", "payload_digest", "payload_length", F.map_entries("headers").alias("headers"))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    last = placed.where(F.col("full") & usable).groupBy("url_key", "part").agg(F.max(response).alias("last"))
    parts = placed.where("url_key is not null").select("url_key", "part").distinct().join(last, ["url_key", "part"], "left")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("url_key", "part", F.max("last").over(earlier).alias("carried")).where("carried is not null")
    before = Window.partitionBy("part", "url_key").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max(F.when(F.col("full") & usable, response)).over(before)).where("revisit")
    found = near.join(carried, ["url_key", "part"], "left").withColumn(
        "base", F.when(usable, F.coalesce("near", "carried")))
    mine, theirs = F.col("headers"), F.map_from_entries("base.headers")
    pairs = [(_tag(mine), _tag(theirs)), (F.element_at(mine, "last-modified"), F.element_at(theirs, "last-modified")),
             (F.col("payload_digest"), F.col("base.payload_digest"))]
    agree = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    state = (F.when(F.col("base").isNull(), "no_base").when(agree.isNull(), "unverified")
             .when(agree, "resolved").otherwise("mismatch"))
    update = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    return (found.withColumn("state", state).select(
        "record_id", "url_key", "ts", "state", F.col("base.record_id").alias("base_id"), F.col("base.ts").alias("base_ts"),
        *[F.when(F.col("state") == "resolved", c).alias(n) for c, n in
          ((F.col("base.payload_digest"), "payload_digest"), (F.col("base.payload_length"), "payload_length"),
           (merged, "headers"))]))


def header_lines(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def _headers(fields: dict[str, Column]) -> Column:
    """A map of the fields that aren't null."""
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from a table of pages: each page is a full response, and is visited again later
    under another spelling of its URL. Page ids are the clock. Some revisits lack an entity tag, some
    have a weak one, some that of another version, and some have no validator at all."""
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                     F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"))
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    modified = F.concat(F.lit("day "), (i % 1000).cast("string"))
    response = p.select(
        F.concat(F.lit("r"), i.cast("string")).alias("record_id"), "url", (i * 60).alias("ts"), F.lit("response").alias("kind"),
        F.when(i % 50 == 49, 404).otherwise(200).alias("status"),
        _headers({"content-type": F.lit("text/html"), "content-length": F.col("length").cast("string"), "etag": tag,
                  "last-modified": modified, "date": F.concat(F.lit("t"), (i * 60).cast("string"))}).alias("headers"),
        F.col("digest").alias("payload_digest"), F.col("length").alias("payload_length"))
    spelling = (F.when(i % 4 == 0, F.concat(F.col("url"), F.lit("#again"))).when(i % 4 == 1, F.regexp_replace("url", "^http:", "HTTP:"))
                .when(i % 4 == 2, F.regexp_replace("url", "^(https?://[^/?#]*)", "$1:443")).otherwise(F.col("url")))
    ts = i * 60 + 30 + i % 7 * 600
    sent = (F.when(i % 11 == 3, F.lit('"other"')).when(i % 11 == 4, F.concat(F.lit("W/"), tag)).when(i % 11 < 9, tag))
    revisit = p.select(
        F.concat(F.lit("v"), i.cast("string")).alias("record_id"), spelling.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        _headers({"date": F.concat(F.lit("t"), ts.cast("string")), "etag": sent, "last-modified": F.when(i % 11 == 9, modified),
                  "content-length": F.lit("0"), "x-cache": F.lit("hit")}).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"))
    return response.unionByName(revisit)


ORACLE_SQL = r"""
with p as (select page_id as i, url, md5(coalesce(html, '')) as digest, cast(strlen(coalesce(html, '')) as bigint) as length from pages),
  t as (select *, '"' || substr(digest, 1, 12) || '"' as tag, 'day ' || cast(i % 1000 as varchar) as modified,
    i * 60 + 30 + i % 7 * 600 as vts from p),
  response as (select 'r' || cast(i as varchar) as record_id, url, i * 60 as ts, map {'content-type': 'text/html',
    'content-length': cast(length as varchar), 'etag': tag, 'last-modified': modified, 'date': 't' || cast(i * 60 as varchar)} as headers,
    digest, length from t where i % 50 <> 49),
  revisit as (select 'v' || cast(i as varchar) as record_id, case i % 4 when 0 then url || '#again'
      when 1 then regexp_replace(url, '^http:', 'HTTP:') when 2 then regexp_replace(url, '^(https?://[^/?#]*)', '\1:443') else url end as url,
    vts as ts, case when i % 11 = 3 then '"other"' when i % 11 = 4 then 'W/' || tag when i % 11 < 9 then tag end as etag,
    case when i % 11 = 9 then modified end as lm from t),
  both_ as (select record_id, url from response union all select record_id, url from revisit),
  cut as (select record_id, regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)([?][^#]*)?(#.*)?$') as ok,
    url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)([?][^#]*)?(#.*)?$',
      ['s', 'u', 'host', 'port', 'path', 'query', 'frag']) as x from both_),
  keyed as (select record_id, case when ok then regexp_replace(lower(x.host), '^www\.', '')
      || case when x.port in (':', ':80', ':443') then '' else x.port end || regexp_replace(x.path, '/$', '')
      || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end else url end as url_key
    from (select *, list_sort(list_filter(string_split(substr(x.query, 2), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as q from cut)),
  r as (select * from response join keyed using (record_id)), v as (select * from revisit join keyed using (record_id)),
  found as (select v.record_id, v.url_key, v.ts, v.etag, v.lm, max({'ts': r.ts, 'record_id': r.record_id, 'digest': r.digest,
      'length': r.length, 'headers': r.headers}) as base from v left join r on v.url_key = r.url_key and r.ts < v.ts group by all),
  judged as (select *, coalesce(regexp_replace(etag, '^W/', '') = base.headers['etag'], lm = base.headers['last-modified']) as agree from found),
  stated as (select *, case when base.record_id is null then 'no_base' when agree is null then 'unverified' when agree then 'resolved'
    else 'mismatch' end as state from judged)
select record_id, url_key, ts, state, base.record_id as base_id, base.ts as base_ts,
  case when state = 'resolved' then base.digest end as payload_digest, case when state = 'resolved' then base.length end as payload_length,
  case when state = 'resolved' then array_to_string(list_sort([
    'content-length: ' || base.headers['content-length'], 'content-type: ' || base.headers['content-type'],
    'date: t' || cast(ts as varchar), 'etag: ' || coalesce(etag, base.headers['etag']),
    'last-modified: ' || coalesce(lm, base.headers['last-modified']), 'x-cache: hit']), chr(10)) end as headers
from stated
"""
