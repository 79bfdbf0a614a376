"""Search plans: text, vector or hybrid, with a pre-filter, over documents and postings.

The plan ranks narrow frames (docid, score) and joins the stored columns only to
the hits.  The filter comes before every cut, never after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import Analyzer
from ..functions.strings import doc_id, snippet, title
from ..model import PROJECT_TOP_K, PROJECT_TOP_K_MAX, EngineError, Schema, SearchQuery
from . import fusion
from .ann import Inverted, ann
from .bm25 import bm25
from .filters import predicate
from .knn import knn, top


def fields(schema: Schema) -> Column:
    """map<string,string> of the stored scalars in JSON form; those that are null are left out."""
    pairs = []
    for n, kind in schema.scalars:
        c = F.col(n)
        value = F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', "$1")
        pairs.append(F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), value.alias("value"))))
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def candidates(docs: DataFrame, postings: DataFrame, schema: Schema, analyzer: Analyzer, q: SearchQuery, k: int, approximate: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """(vector list, text list), each (id: docid, score), at most k long; None for an input that is missing."""
    if q.vector is not None and len(q.vector) != schema.dim:
        raise EngineError("INVALID_ARG", f"the query vector needs {schema.dim} dimensions")
    where = predicate(q.filter, schema.kinds())
    allowed = docs if where is None else docs.where(where)
    mode = q.resolved_mode()
    vec = txt = None
    if mode in ("vector", "hybrid") and q.vector is not None:
        if approximate:
            index = Inverted.train(docs, metric=schema.metric)
            vec = ann(index.assigned(docs), index, q.vector, k, key="docid", allowed=where)
        else:
            vec = knn(allowed, q.vector, k, schema.metric, key="docid")
    if mode in ("text", "hybrid") and q.text is not None:
        stats = docs.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
        txt = bm25(postings, stats, analyzer.tokens(q.text), k, None if where is None else allowed.select("docid"))
    return vec, txt


def ids(docs: DataFrame, postings: DataFrame, schema: Schema, analyzer: Analyzer, q: SearchQuery, approximate: bool = False) -> DataFrame:
    """(id: docid, score) of the hits."""
    mode = q.resolved_mode()
    k = q.top_k * max(1, q.multiplier) if mode == "hybrid" else q.top_k
    vec, txt = candidates(docs, postings, schema, analyzer, q, k, approximate)
    lists = [x for x in (vec, txt) if x is not None]
    if not lists:
        return docs.sparkSession.createDataFrame([], "id long, score double")
    if mode != "hybrid":
        return lists[0]
    if q.fusion == "linear":
        empty = docs.sparkSession.createDataFrame([], "id long, score double")
        return fusion.fuse(vec if vec is not None else empty, txt if txt is not None else empty, q.top_k, "linear", q.alpha)
    ranked = reduce(DataFrame.unionByName, [fusion.ranked(x).select("id", "rank") for x in lists])
    return top(fusion.rrf(ranked), q.top_k)


def run(docs: DataFrame, postings: DataFrame, schema: Schema, analyzer: Analyzer, q: SearchQuery, approximate: bool = False) -> DataFrame:
    """(id, score, fields) in order of score, then docid."""
    hits = ids(docs, postings, schema, analyzer, q, approximate).withColumnRenamed("id", "docid")
    stored = docs.select("docid", "id", *[n for n, _ in schema.scalars])
    out = stored.join(F.broadcast(hits), "docid")  # at most top_k rows
    return out.orderBy(F.desc("score"), "docid").select("id", "score", fields(schema).alias("fields"))


def clamp(top_k: int) -> int:
    return PROJECT_TOP_K if top_k <= 0 else min(top_k, PROJECT_TOP_K_MAX)


def project_search(collection, text: str, embed, top_k: int = 0, root: str | None = None, extractor: str | None = None) -> DataFrame:
    """Hybrid search with the query embedded here; text search, marked degraded, where embedding fails."""
    k = clamp(top_k)
    where = {n: v for n, v in (("root", root), ("extractor", extractor)) if v}
    degraded, vector = False, None
    try:
        vector = tuple(embed([text])[0])
    except Exception:  # any failure of a remote model
        degraded = True
    q = SearchQuery(text=text, vector=vector, top_k=k, filter=where)
    return collection.search(q).withColumn("degraded", F.lit(degraded))


def search_all(collections: dict, text: str, embeds: dict, top_k: int = 0, models: dict | None = None) -> DataFrame:
    """Across projects: each project's list, then reciprocal ranks; a query is embedded once a model."""
    known: dict = {}

    def once(name):
        model = (models or {}).get(name, name)

        def run(texts):
            if model not in known:
                known[model] = embeds[name](texts)
            return known[model]

        return run

    lists = []
    for i, (name, c) in enumerate(collections.items()):
        hits = project_search(c, text, once(name), top_k)
        lists.append(fusion.ranked(hits).select(F.lit(name).alias("project"), F.lit(i).alias("list"), "id", "rank", "degraded"))
    return fusion.rrf_projects(reduce(DataFrame.unionByName, lists), clamp(top_k))


def display(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with title, snippet and path of their chunks (id = project:path#index)."""
    c = chunks.withColumn("id", doc_id(F.col("project"), F.col("path"), F.col("chunk_index")))
    crumb = F.array_join("headings", " > ")
    return hits.join(c, "id", "left").select(*[hits[x] for x in hits.columns], "path", title(F.col("headings"), F.col("path")).alias("title"), snippet(F.col("text"), crumb).alias("snippet"))


def read_path(chunks: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """All chunks of a file in order; a path that several roots hold must be told by its root."""
    own = chunks.where(F.col("path") == path)
    if root is not None:
        own = own.where(F.col("project") == root)
    elif len(own.select("project").distinct().limit(2).collect()) > 1:
        raise EngineError("INVALID_ARG", f"{path} exists in several roots")
    return own.orderBy("chunk_index")


def explain_empty(facts: dict) -> str:
    """Why a query found nothing: the first of the known reasons that holds."""
    order = ["not_initialized", "not_registered", "still_indexing", "embedder", "excluded", "wrong_root", "empty_index"]
    return next((r for r in order if facts.get(r)), "no_match")


def scope(cwd: str, configured: set[str], roots: list[str]) -> list[str]:
    """The roots to search from a folder: the nearest folder upwards with its own config, else the longest root above, else all."""
    parts = cwd.rstrip("/").split("/")
    up = ["/".join(parts[:i]) or "/" for i in range(len(parts), 0, -1)]
    for p in up:
        if p in configured:
            return [p]
    for p in up:
        if p in roots:
            return [p]
    return list(roots)
