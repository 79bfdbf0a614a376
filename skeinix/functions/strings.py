"""Keys, names, urls, paths and small text functions, as JVM expressions (with driver forms where a driver needs them)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SNIPPET

NUL = "\u0000"


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def chunk_strategy_id(split: str = "markdown", max_chars: int = 1200, overlap_chars: int = 200, min_chars: int = 50, extractor_ver: str = "1") -> str:
    canon = json.dumps(dict(split=split, max_chars=max_chars, overlap_chars=overlap_chars, min_chars=min_chars, extractor_ver=extractor_ver), separators=(",", ":"))
    return hashlib.sha256(canon.encode()).hexdigest()[:16]


def extract_key(file_sha: Column, extractor: Column, version: Column, strategy: Column) -> Column:
    return _sha(file_sha, extractor, version, strategy)


def embed_key(text: Column, model_id: Column) -> Column:
    return _sha(text, model_id)


def project_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def doc_id(project: Column, path: Column, index: Column) -> Column:
    return F.concat(project, F.lit(":"), path, F.lit("#"), index.cast("string"))


def parse_doc_id(c: Column) -> Column:
    """struct(project, path, chunk) by the first ':' and the last '#'; null if it isn't one."""
    ok = c.rlike(r"(?s)^[^:]*:.*#\d{1,9}$")
    part = lambda i: F.regexp_extract(c, r"(?s)^([^:]*):(.*)#(\d{1,9})$", i)
    return F.when(ok, F.struct(part(1).alias("project"), part(2).alias("path"), part(3).cast("int").alias("chunk")))


def embed_model_id(provider: Column, model: Column, dim: Column) -> Column:
    return F.concat_ws(":", provider, model, dim.cast("string"))


def parse_embed_model_id(c: Column) -> Column:
    """struct(provider, model, dim): dim after the last colon; the model may hold colons."""
    pattern = r"(?s)^([^:]*):(.*):(\d{1,9})$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("provider"), F.regexp_extract(c, pattern, 2).alias("model"), F.regexp_extract(c, pattern, 3).cast("int").alias("dim")))


def embeddings_url(base: Column) -> Column:
    b = F.regexp_replace(base, "/+$", "")
    return F.when(b.endswith("/embeddings"), b).when(b.endswith("/v1"), F.concat(b, F.lit("/embeddings"))).otherwise(F.concat(b, F.lit("/v1/embeddings")))


def probe_error_code(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("http 401|http 403|unauthorized|invalid_api_key|invalid api key"), "embed_auth").when(m.rlike("dim mismatch|dim changed"), "embed_dim").when(m.rlike("transport|connection refused|timed out|dns"), "embed_unreachable").otherwise("embed_probe")


def skip_kind(message: Column, is_skip: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("utf-?8"), "invalid_utf8").when(is_skip & m.contains("too large"), "too_large").when(is_skip, "extractor_unsupported")


def redact(line: Column) -> Column:
    """Secret tokens and the values of api_key assignments become ***."""
    out = F.regexp_replace(line, "sk-(proj-)?[A-Za-z0-9_-]*", "sk-$1***")
    return F.regexp_replace(out, r"""(?i)(?<![A-Za-z0-9_])(api_key)(?![A-Za-z0-9_])([\s"']*[=:][\s"']*)[^\s"',}]+""", "$1$2***")


def relative_time(ts: Column, now: Column) -> Column:
    """Epoch seconds as an English phrase; a date from 30 days on."""
    d = now - ts
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(ts == 0, "never").when(d < 10, "just now").when(d < 60, ago(d, "seconds")).when(d < 3600, ago(d / 60, "minutes")).when(d < 48 * 3600, ago(d / 3600, "hours")).when(d < 30 * 86400, ago(d / 86400, "days")).otherwise(date_of(ts))


def date_of(ts: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int")), "yyyy-MM-dd")


def mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "gif", "image/gif").otherwise("application/octet-stream")


def normal_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_path_prefix(root: Column, path: Column) -> Column:
    """Whether path is root or lies below it (/a holds /a/b but not /ab)."""
    return (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): for each path the longest root that holds it; null if none does.

    Every ancestor of a path is looked up by an equality join, so no pairs of paths and roots are formed.
    """
    up = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    each = paths.select("path", F.explode(above).alias("a"))
    r = roots.select(F.col("root"), F.regexp_replace("root", "/+$", "").alias("a"))
    best = each.join(r, "a").groupBy("path").agg(F.max_by("root", F.length("a")).alias("root"))
    return paths.join(best, "path", "left").select("path", "root")


def nested(roots: DataFrame) -> DataFrame:
    """(root, inside): roots that lie inside another one."""
    up = F.split(F.regexp_replace("root", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(up) - 1, F.lit(1))), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    each = roots.select(F.col("root"), F.explode(above).alias("a"))
    return each.join(roots.select(F.col("root").alias("inside"), F.regexp_replace("root", "/+$", "").alias("a")), "a").where("root <> inside").select("root", "inside").distinct()


def snippet(text: Column, crumb: Column, n: int = SNIPPET) -> Column:
    """The first n characters after the breadcrumb line, where the first line is one."""
    first = F.regexp_extract(text, r"^([^\n]*)\n", 1)
    rest = F.regexp_replace(text, r"^[^\n]*\n", "")
    is_crumb = F.locate("\n", text).__gt__(0) & (F.locate(" > ", first).__gt__(0) | F.coalesce(first == crumb, F.lit(False)))
    return F.substring(F.when(is_crumb, rest).otherwise(text), 1, n)


def title(headings: Column, path: Column) -> Column:
    return F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(file_name(path))


def nth_hit(hits: DataFrame, n: int) -> DataFrame:
    """The n-th hit, from 1, of a ranked list (rank from 0, id, score)."""
    return hits.where(F.col("rank") == n - 1)


def last_issues(issues: DataFrame, keep: int = 200) -> DataFrame:
    """The newest ``keep`` issues of each root: (root, path, reason, at)."""
    w = Window.partitionBy("root").orderBy(F.desc("at"), "path")
    return issues.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")
