"""Operator 6: resolution of not-modified revisit records.

A revisit is joined, as of its time, to the latest earlier full response of the
same canonical URL.  Its validators must agree (the payload digest where it names
one, else the entity tag by weak comparison, else the last-modified date; one of
them at least), then the response's payload stands for it and the headers that a
not-modified answer may change replace the stored ones.

The join is made of partial aggregations and windows.  Records of a URL at one second
are one point, so a time bucket of a URL has no more points than seconds, whatever the
number of its records; the window inside a bucket runs over points, the latest response
of each bucket comes from a combined aggregation, only those pass through a window over
the URL, and what a bucket inherits is joined back by equality.  Revisits find the answer
of their point by equality too, a join that adaptive execution splits when skewed.
Payloads don't move; headers are joined to the pairs that were found.

Defined cases: a null URL or time resolves to nothing; of responses at one time the
greatest record_id is the latest; a response at a revisit's own time isn't earlier;
repeated rows give repeated rows; null headers count as none; very long values are taken
whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .url_filter import _LOW, _UP, host_of, rest_of

#: A not-modified answer doesn't change what describes the stored body.
KEPT = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "trailer", "upgrade"]
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, fragment, leading www. or m., or tracking parameters; null without ://."""
    host = F.regexp_replace(host_of(url), "^(www|m)\\.", "")
    path = F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest_of(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")), "&")
    return F.when(F.locate("://", url) > 0, F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, bucket: int = 86_400) -> DataFrame:
    """records: record_id long, url string, ts long (seconds), kind ('response' or 'revisit'), status int, headers map<string,string> (names in lower case), payload_digest string.

    A row for each revisit: record_id, canonical, ts, refers_to, outcome ('resolved', 'mismatch', 'no response'), payload_digest and merged headers (null unless resolved).
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload_digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    slim = r.where(full | (F.col("kind") == "revisit")).select("record_id", "canonical", "ts", (F.col("kind") == "revisit").alias("asks"), F.floor(F.col("ts") / bucket).alias("tb"))
    known = slim.where("canonical is not null and ts is not null")
    points = known.groupBy("canonical", "tb", "ts").agg(F.max(F.when(~F.col("asks"), F.col("record_id"))).alias("rid"), F.max("asks").alias("asked"))
    at = F.when(F.col("rid").isNotNull(), F.struct("ts", "rid"))
    per = points.groupBy("canonical", "tb").agg(F.max(at).alias("latest"))
    before = Window.partitionBy("canonical").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    inherited = per.select("canonical", "tb", F.last("latest", ignorenulls=True).over(before).alias("inherited"))
    inside = Window.partitionBy("canonical", "tb").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    asked = points.select("*", F.last(at, ignorenulls=True).over(inside).alias("own")).where("asked").join(inherited, ["canonical", "tb"])
    answers = asked.select("canonical", "ts", F.coalesce("own", "inherited")["rid"].alias("refers_to"))
    pairs = known.where("asks").select("record_id", "canonical", "ts").join(answers, ["canonical", "ts"]).select("record_id", "refers_to")
    revisits = r.where("kind = 'revisit'").select("record_id", "canonical", "ts", F.col("headers").alias("h"), F.col("payload_digest").alias("d"))
    stored = r.where(full).select(F.col("record_id").alias("refers_to"), F.col("headers").alias("sh"), F.col("payload_digest").alias("sd"))
    j = revisits.join(pairs.distinct(), "record_id", "left").join(stored.dropDuplicates(["refers_to"]), "refers_to", "left")
    tag, mod = F.col("h")["etag"], F.col("h")["last-modified"]
    agrees = F.when(F.col("d").isNotNull(), F.col("d") == F.col("sd")).when(tag.isNotNull(), _weak(tag) == _weak(F.col("sh")["etag"])).when(mod.isNotNull(), mod == F.col("sh")["last-modified"])
    ok = F.coalesce(agrees, F.lit(False))
    outcome = F.when(F.col("refers_to").isNull(), "no response").when(ok, "resolved").otherwise("mismatch")
    new = F.map_filter("h", lambda k, v: ~k.isin(KEPT))
    merged = F.map_concat(F.map_filter("sh", lambda k, v: ~F.map_contains_key(new, k)), new)
    return j.select("record_id", "canonical", "ts", "refers_to", outcome.alias("outcome"), F.when(ok, F.col("sd")).alias("payload_digest"), F.when(ok, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages: each is fetched, and asked for again later.

    Page p is stored at second 3600 p (record 2p) and asked for again ten days later
    (record 2p + 1) with an entity tag; every seventh page has another tag by then,
    and every third is asked for by its last-modified date.
    """
    p = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("digest"), F.length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("string").alias("n"))
    ts = F.col("p") * 3600
    stored = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("digest")), F.lit("last-modified"), (ts - 60).cast("string"), F.lit("date"), ts.cast("string"), F.lit("content-length"), F.col("n"), F.lit("content-type"), F.lit("text/html"))
    again = ts + 864_000
    tag = F.when(F.col("p") % 7 == 0, F.reverse("digest")).otherwise(F.col("digest"))
    by_tag = F.create_map(F.lit("etag"), tag, F.lit("date"), again.cast("string"), F.lit("content-length"), F.lit("0"))
    by_date = F.create_map(F.lit("last-modified"), (ts - 60).cast("string"), F.lit("date"), again.cast("string"), F.lit("content-length"), F.lit("0"))
    rows = F.array(
        F.struct((F.col("p") * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), stored.alias("headers"), F.col("digest").alias("payload_digest")),
        F.struct((F.col("p") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when(F.col("p") % 3 == 0, by_date).otherwise(by_tag).alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
    )
    return p.select(F.inline(rows))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return out.select("record_id", "canonical", "ts", "refers_to", "outcome", "payload_digest", h["etag"].alias("etag"), h["date"].alias("date"), h["last-modified"].alias("last_modified"), h["content-length"].alias("content_length"), h["content-type"].alias("content_type"))


SQL = {
    "op6_warc_revisits": f"""
with u as (select page_id::bigint as p, url, substr(url, strpos(url, '://') + 3) as r, md5(coalesce(html, '')) as d, length(coalesce(html, ''))::varchar as n from pages),
c as (select p, d, n, case when strpos(url, '://') > 0 then regexp_replace(translate(regexp_extract(r, '^[^/?#]*'), '{_UP}', '{_LOW}'), '^(www|m)\\.', '')
  || case when regexp_extract(r, '^[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(r, '^[^/?#]*([^?#]*)', 1) end
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(r, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}')), '&'), ''), '') end as canonical from u),
s as (select p * 2 as id, canonical, p * 3600 as ts, d, n, p from c),
v as (select p * 2 + 1 as record_id, canonical, p * 3600 + 864000 as ts, p, d from c),
m as (select v.record_id, max((s.ts, s.id)) as best from v join s on v.canonical = s.canonical and s.ts < v.ts group by 1),
j as (select v.*, s.id as refers_to, s.d as sd, s.n as sn, s.p as sp,
  coalesce(case when v.p % 3 = 0 then v.p = s.p else (case when v.p % 7 = 0 then reverse(v.d) else v.d end) = s.d end, false) as ok
  from v left join m using (record_id) left join s on s.ts = struct_extract_at(m.best, 1) and s.id = struct_extract_at(m.best, 2) and s.canonical = v.canonical)
select record_id, canonical, ts, refers_to, case when refers_to is null then 'no response' when ok then 'resolved' else 'mismatch' end as outcome,
  case when ok then sd end as payload_digest,
  case when ok then case when p % 3 = 0 then 'W/' || sd when p % 7 = 0 then reverse(d) else d end end as etag,
  case when ok then ts::varchar end as date, case when ok then (case when p % 3 = 0 then p * 3600 - 60 else sp * 3600 - 60 end)::varchar end as last_modified,
  case when ok then sn end as content_length, case when ok then 'text/html' end as content_type
from j""",
}
