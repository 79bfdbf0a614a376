"""Operator 2: URL rules, and block decisions that follow redirects and canonical links.

A rule is ``host/path-prefix``: it fits its host and all subdomains if the url's
path starts with the prefix; the longest fitting rule decides.  Urls that no rule
fits are judged by equivalence: redirects and canonical links are edges, connected
components of them (distributed union-find) are aliases of one another, and a
component in which any url is blocked by a rule blocks its undecided members.  An
explicit allow always stands.  Undecided urls of components without a block are
allowed.

Everything but union-find stays in JVM expressions.  Defined cases: a null url, or
one without ``://``, has empty host and path, fits no rule and has no edges; null
html has no edges; edges to nowhere, loops and repeated rows change nothing; of rules of
equal length an allow wins; an empty table gives no rows; very long urls and texts are
taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table
from .components import components

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_META = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF, _URL = (rf"""(?i)\b{x}\s*=\s*["']?([^"'\s>]+)""" for x in ("href", "url"))


def rest_of(url: Column) -> Column:
    """What follows the first ://; null without one."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; among equals an allow; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def normal(url: Column) -> Column:
    """One name for a url: scheme and host in lower case, no fragment, a path at least '/'."""
    path = F.regexp_extract(rest_of(url), "^[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.regexp_extract(url, "^([^:]*)://", 1), _UP, _LOW)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path)))


def resolve(base: Column, to: Column) -> Column:
    """An absolute url from a link: absolute, //host, /path, or beside the base's last path segment."""
    root = F.regexp_extract(base, "^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    beside = F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to)
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), to)).when(to.startswith("/"), F.concat(root, to)).when(F.length(to) > 0, beside)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): urls joined by a canonical link or a refresh redirect in a page."""
    p = pages.select(F.col(url).cast("string").alias("a"), F.col(html).cast("string").alias("h")).where("locate('://', a) > 0 and h rlike '(?i)canonical|refresh'")
    link = F.regexp_extract(F.regexp_extract("h", _LINK, 0), _HREF, 1)
    meta = F.regexp_extract(F.regexp_extract("h", _META, 0), _URL, 1)
    return p.select("a", F.explode(F.array(link, meta)).alias("to")).where("to <> ''").select("a", resolve(F.col("a"), F.col("to")).alias("b")).where("locate('://', b) > 0")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, component (null for a url without edges).

    redirects: (from, to) urls besides those that the pages' html holds.
    """
    edges = page_edges(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(F.col("from").cast("string").alias("a"), F.col("to").cast("string").alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    p = p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(normal(F.col("url"))).alias("node"), normal(F.col("url")).isNotNull().alias("real"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), "node", "real")
    if edges is None:
        return p.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("component"))
    edges = settled(edges.where("locate('://', a) > 0 and locate('://', b) > 0").select(normal(F.col("a")).alias("a"), normal(F.col("b")).alias("b")).where("a <> b").distinct())
    joined = components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    ends = edges.select(F.col("a").alias("u")).unionByName(edges.select(F.col("b").alias("u"))).distinct()
    end_rule, end_verdict = rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)
    bad = ends.where(end_verdict == "block").select(F.xxhash64("u").alias("node")).join(joined, "node").select("component").distinct().withColumn("bad", F.lit(True))
    named = settled(joined.join(bad, "component", "left"))
    out = p.join(named, (p["node"] == named["node"]) & p["real"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"), "component")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def cases(what: bool) -> str:
        order = sorted(RULES, key=lambda r: (len(r[1]), r[0] == "allow"), reverse=True)
        split = [(k, t, *t.split("/", 1)) for k, t in order]
        return " ".join(f"when (h = '{h}' or ends_with(h, '.{h}')) and starts_with(p, '/{p}') then '{k if what else t}'" for k, t, h, p in split)

    def after(u: str) -> str:
        return f"case when strpos({u}, '://') > 0 then substr({u}, strpos({u}, '://') + 3) end"

    def host(u: str) -> str:
        return f"translate(regexp_extract({after(u)}, '^[^/?#]*'), '{_UP}', '{_LOW}')"

    def path(u: str) -> str:
        return f"regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1)"

    def norm(u: str) -> str:
        return f"translate(regexp_extract({u}, '^([^:]*)://', 1), '{_UP}', '{_LOW}') || '://' || {host(u)} || coalesce(nullif(regexp_extract({after(u)}, '^[^/?#]*([^#]*)', 1), ''), '/')"

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def target(tag: str, attribute: str) -> str:
        return f"regexp_extract(regexp_extract(html, {quoted(tag)}), {quoted(attribute)}, 1)"

    folder = "regexp_extract(a, '^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
    return f"""
with recursive v as (select page_id, url, html, coalesce({host("url")}, '') as h, coalesce({path("url")}, '') as p, {norm("url")} as n from pages),
link as (select url as a, unnest([{target(_LINK, _HREF)}, {target(_META, _URL)}]) as t from v where strpos(url, '://') > 0),
full_link as (select a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then regexp_extract(a, '^([^:]*:)', 1) || t
  when starts_with(t, '/') then regexp_extract(a, '^([^:]*://[^/?#]*)', 1) || t else {folder} || case when ends_with({folder}, '/') then '' else '/' end || t end as b from link where t <> ''),
one as (select {norm("a")} as a, {norm("b")} as b from full_link where strpos(b, '://') > 0),
edge as (select a, b from one where a <> b union select b, a from one where a <> b),
reach as (select a as x, a as y from edge union select reach.x, edge.b from reach join edge on reach.y = edge.a),
ends as (select url, coalesce({host("url")}, '') as h, coalesce({path("url")}, '') as p from (select distinct a as url from edge)),
bad as (select url from ends where case {cases(True)} end = 'block'),
tainted as (select distinct x from reach join bad on reach.y = bad.url)
select page_id, h as host, p as path, case {cases(False)} end as rule, coalesce(case {cases(True)} end, case when n in (select x from tainted) then 'block' end, 'allow') as verdict from v"""


SQL = {"op2_url_filter": _sql()}
