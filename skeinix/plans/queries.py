"""Registered queries over whole tables, with SQL that gives the same rows.

Scores are doubles; lists are ordered by the score rounded to 9 digits, then by id,
so that two engines order alike, and shown with 6.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.analyze import analyzer, cjk_bigrams, prune_dictionary, simple, term_counts
from ..functions.chunk import ChunkConfig, chunks
from ..functions.glob import Policy, TypeRule, classify
from ..model import Schema
from ..operators import ann, bm25, evaluate, fusion, ingest, knn
from ..operators.contain import holding
from ..sources.embed import hash_embedding
from ..streaming.streams import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TERMS = ["the", "heron", "inesh", "that"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark, sf) -> DataFrame:
    return T(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def _query_vector(v: DataFrame) -> list[float]:
    row = v.where("id = 0").select("vector").first()
    return [float(x) for x in row.vector]


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)).select(*(cols or df.columns))


# -- vectors ------------------------------------------------------------------
_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_MEASURE = {"cosine": "list_cosine_similarity(embedding::double[], q)", "l2": "-list_distance(embedding::double[], q)", "dot": "list_inner_product(embedding::double[], q)"}


def _knn_sql(metric: str, where: str = "true", k: int = 100) -> str:
    return f"select vec_id as id, round(s, 6) + 0.0::double as score from (select vec_id, round({_MEASURE[metric]}, 9) as s from embeddings, {_Q} where {where} order by s desc, vec_id limit {k})"


@query(_knn_sql("cosine"))
def knn_cosine(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn(v, _query_vector(v), 100, "cosine", digits=9))


@query(_knn_sql("l2"))
def knn_l2(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn(v, _query_vector(v), 100, "l2", digits=9))


@query(_knn_sql("dot"))
def knn_dot(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn(v, _query_vector(v), 100, "dot", digits=9))


def _filtered(spark, sf, spec):
    from ..operators.filters import predicate

    v = _vectors(spark, sf)
    return _shown(knn.knn(v.where(predicate(spec, {"label": "int"})), _query_vector(v), 50, digits=9))


@query(_knn_sql("cosine", "label = 3", 50))
def knn_filtered_eq(spark, sf):
    return _filtered(spark, sf, {"label": 3})


@query(_knn_sql("cosine", "label in (1, 4, 7)", 50))
def knn_filtered_in(spark, sf):
    return _filtered(spark, sf, {"label": {"in": [1, 4, 7]}})


@query(_knn_sql("cosine", "label >= 2 and label <= 5", 50))
def knn_filtered_range(spark, sf):
    return _filtered(spark, sf, {"label": {"gte": 2, "lte": 5}})


_BATCH_SQL = """select qid, rank, id, round(s, 6) as score from (
  select q.vec_id as qid, e.vec_id as id, round({m}, 9) as s, row_number() over (partition by q.vec_id order by round({m}, 9) desc, e.vec_id) as rank
  from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0) where rank <= 10"""


@query(_BATCH_SQL.format(m="list_cosine_similarity(e.embedding::double[], q.embedding::double[])"))
def knn_batch(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn_batch(v, v.where("id % 50 = 0"), 10, skip_self=True, digits=9))


@query(_BATCH_SQL.format(m="-list_distance(e.embedding::double[], q.embedding::double[])"))
def knn_batch_l2(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn_batch(v, v.where("id % 50 = 0"), 10, "l2", skip_self=True, digits=9))


_SQ8 = """e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings),
r as (select d, min(x) as lo, max(x) as hi from e group by d),
c as (select vec_id, d, lo, hi, case when hi > lo then round((x - lo) / (hi - lo) * 255)::int else 0 end as code from e join r using (d))"""


@query(f"with {_SQ8} select vec_id as id, string_agg(code::varchar, ',' order by d) as codes from c group by vec_id")
def sq8_encode(spark, sf):
    return knn.sq8_table(_vectors(spark, sf)).select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(f"""with {_SQ8}, v as (select vec_id, d, lo + code / 255.0::double * (hi - lo) as x from c),
q as (select d, x from v where vec_id = 0)
select vec_id as id, round(s, 6) as score from (
  select v.vec_id, round(sum(v.x * q.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(q.x * q.x))), 9) as s from v join q using (d) group by v.vec_id order by s desc, v.vec_id limit 50)""")
def sq8_knn(spark, sf):
    v = _vectors(spark, sf)
    return _shown(knn.knn_sq8(v, _query_vector(v), 50, digits=9))


@query()
def ann_ivf(spark, sf):
    """Inverted-file search; a test holds its recall on these vectors against the exact one, for every query whose id is divisible by 50."""
    v = _vectors(spark, sf)
    index = ann.Inverted.train(v)
    return _shown(ann.ann(index.assigned(v), index, _query_vector(v), 50, digits=9))


# -- text ---------------------------------------------------------------------
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_POST = f"""tok as (select doc_id, {_TOK} as t, lang from documents),
post as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by all),
st as (select count(*) as n, avg(len(t)::double) as avgdl from tok)"""
_W = "ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)))"
_IN = ", ".join(f"'{t}'" for t in TERMS)


def _tok(spark, sf) -> DataFrame:
    return bm25.tokenised(T(spark, sf, "documents"), key="doc_id")


def _texts(spark, sf) -> DataFrame:
    return T(spark, sf, "documents").select(F.col("doc_id").alias("docid"), "text")


def _bm25_sql(k: int, where: str = "true", name: str = "bm") -> str:
    return f"""{name} as (select doc_id as id, round(sum({_W}), 9) as score from post join (select term, count(*) as df from post where term in ({_IN}) group by term) using (term) cross join st
  where doc_id in (select doc_id from tok where {where}) group by doc_id order by score desc, id limit {k})"""


@query(f"with tok as (select doc_id, {_TOK} as t from documents) select doc_id as id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from tok")
def tokenize_counts(spark, sf):
    return _tok(spark, sf).select(F.col("docid").alias("id"), F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(f"with {_POST} select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from post group by term")
def term_frequencies(spark, sf):
    return bm25.postings(_tok(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query(f"with {_POST} select n, round(avgdl, 6) as avgdl, (select count(distinct term) from post) as terms from st")
def field_stats(spark, sf):
    tok = _tok(spark, sf)
    return bm25.stats(tok).crossJoin(F.broadcast(bm25.doc_freq(bm25.postings(tok)).agg(F.count("*").alias("terms")))).select("n", F.round("avgdl", 6).alias("avgdl"), "terms")


@query(f"with {_POST}, {_bm25_sql(50)} select id, round(score, 6) as score from bm")
def bm25_topk(spark, sf):
    tok = _tok(spark, sf)
    return _shown(bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, 50, digits=9))


@query(f"with {_POST}, {_bm25_sql(50, where=chr(39).join(['lang = ', 'en', '']))} select id, round(score, 6) as score from bm")
def bm25_filtered(spark, sf):
    tok = _tok(spark, sf)
    allowed = T(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("docid"))
    return _shown(bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, 50, allowed, digits=9))


_BATCH_BM = f"""{_POST}, q as (select distinct item_id as qid, unnest({_TOK}) as term from benchmark),
df as (select term, count(*) as df from post where term in (select term from q) group by term),
hits as (select qid, doc_id as id, round(sum({_W}), 9) as score from q join df using (term) join post using (term) cross join st group by all),
ranked as (select *, row_number() over (partition by qid order by score desc, id) as rank from hits)"""


def _bm25_batch(spark, sf, k):
    q = T(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), simple(F.col("text")).alias("tokens"))
    return bm25.bm25_batch_texts(_texts(spark, sf), q, k, digits=9)


@query(f"with {_BATCH_BM} select qid, rank, id, round(score, 6) as score from ranked where rank <= 10")
def bm25_batch(spark, sf):
    return _shown(_bm25_batch(spark, sf, 10))


@query("""select * from (values (0, '机器,器学,学习'), (1, '世界'), (2, '中,文'), (3, ''), (4, '検索,索エ,エン,ンジ,ジン')) t(id, tokens)""")
def cjk_bigram_tokens(spark, sf):
    rows = spark.createDataFrame([(0, "机器学习"), (1, "hello 世界 ok"), (2, "中a文"), (3, "plain"), (4, "検索エンジン x")], "id int, text string")
    return rows.select("id", F.array_join(cjk_bigrams(F.col("text")), ",").alias("tokens"))


@query()
def standard_terms(spark, sf):
    """Frequencies of stemmed terms; tests hold the analyzer against its published rules."""
    return term_counts(T(spark, sf, "documents").select("text"), analyzer("standard").tokens)


@query(f"""with w as (select unnest({_TOK}) as word from documents), f as (select word, count(*) as freq from w group by word)
select word, freq from f where length(word) = 1 union all (select word, freq from f where length(word) > 1 order by freq desc, word limit 500)""")
def dictionary_pruning(spark, sf):
    words = T(spark, sf, "documents").select(F.explode(simple(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    lines = words.orderBy("word").select(F.concat_ws(" ", "word", F.col("freq").cast("string"), F.lit("n")).alias("value"))
    return prune_dictionary(lines, 500)


# -- fusion -------------------------------------------------------------------
_VEC = f"vec as (select vec_id as id, round({_MEASURE['cosine']}, 9) as score from embeddings, {_Q} order by score desc, id limit 30)"
_RANK = lambda t: f"(select id, row_number() over (order by score desc, id) - 1 as rank from {t})"
_RRF = f"(select id, sum(1.0::double / (60 + rank)) as score from (select * from {_RANK('vec')} union all select * from {_RANK('bm')}) group by id)"


def _lists(spark, sf, where: str | None = None):
    v, docs = _vectors(spark, sf), T(spark, sf, "documents")
    tok = _tok(spark, sf)
    allowed = None if where is None else docs.where(where).select(F.col("doc_id").alias("docid"))
    pool = v if where is None else v.join(allowed.withColumnRenamed("docid", "id"), "id", "left_semi")
    return knn.knn(pool, _query_vector(v), 30, digits=9), bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, 30, allowed, digits=9)


@query(f"with {_POST}, {_bm25_sql(30)}, {_VEC} select id, round(score, 9) as score from {_RRF} order by round(score, 12) desc, id limit 10")
def hybrid_rrf(spark, sf):
    vec, txt = _lists(spark, sf)
    lists = fusion.ranked(vec).select("id", "rank").unionByName(fusion.ranked(txt).select("id", "rank"))
    return fusion.top(fusion.rrf(lists).withColumn("score", F.round("score", 12)), 10).withColumn("score", F.round("score", 9))


@query(f"""with {_POST}, {_bm25_sql(30, where="lang = 'en'")}, vec as (select vec_id as id, round({_MEASURE['cosine']}, 9) as score from embeddings, {_Q} where vec_id in (select doc_id from documents where lang = 'en') order by score desc, id limit 30)
select id, round(score, 9) as score from {_RRF} order by round(score, 12) desc, id limit 10""")
def hybrid_rrf_filtered(spark, sf):
    vec, txt = _lists(spark, sf, "lang = 'en'")
    lists = fusion.ranked(vec).select("id", "rank").unionByName(fusion.ranked(txt).select("id", "rank"))
    return fusion.top(fusion.rrf(lists).withColumn("score", F.round("score", 12)), 10).withColumn("score", F.round("score", 9))


_NORM = lambda t: f"(select id, case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else 0 end as s from {t})"


@query(f"""with {_POST}, {_bm25_sql(30)}, {_VEC},
f as (select id, round(0.4::double * coalesce(v.s, 0) + 0.6::double * coalesce(t.s, 0), 9) as score from {_NORM('vec')} v full join {_NORM('bm')} t using (id))
select id, round(score, 6) as score from f order by f.score desc, id limit 10""")
def hybrid_linear(spark, sf):
    vec, txt = _lists(spark, sf)
    return _shown(fusion.top(fusion.linear(vec, txt, 0.4).withColumn("score", F.round("score", 9)), 10))


@query(f"with {_POST}, {_bm25_sql(50)} select id, round(score, 6) as score, round(s, 6) as norm from bm join {_NORM('bm')} using (id)")
def minmax_norm(spark, sf):
    tok = _tok(spark, sf)
    return _shown(fusion.normalised(bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, 50, digits=9))).withColumn("norm", F.round("norm", 6))


_PROJ = f"""pp as (select lang as project, doc_id as id, round(sum({_W}), 9) as s from post join (select term, count(*) as df from post where term in ({_IN}) group by term) using (term) cross join st join (select doc_id, lang from tok) using (doc_id) group by all),
pr as (select *, row_number() over (partition by project order by s desc, id) - 1 as rank from pp)"""


@query(f"with {_POST}, {_PROJ} select id, round(1.0::double / (61 + rank), 9) as score, project = 'de' as degraded, project from pr where rank < 8 order by score desc, id limit 20")
def rrf_multi_project(spark, sf):
    tok = _tok(spark, sf)
    scored = bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, digits=9).join(T(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("project")), "id")
    lists = fusion.ranked(scored, "project").where("rank < 8").select("project", F.col("project").alias("list"), "id", "rank", (F.col("project") == "de").alias("degraded"))
    return fusion.rrf_projects(lists, 20).withColumn("score", F.round("score", 9)).select("id", "score", "degraded", "project")


@query(f"""with {_BATCH_BM}, rel as (select item_id as qid, doc_id as id from benchmark b join documents d on strpos(d.text, b.text) > 0),
t as (select qid, count(distinct id) as n from rel group by qid), f as (select distinct qid, id from ranked where rank <= 10)
select t.qid, round((select count(*) from f join (select distinct * from rel) r using (qid, id) where f.qid = t.qid) / least(10, n)::double, 6) as recall from t""")
def recall_at_10(spark, sf):
    rel = _holds(spark, sf)
    return evaluate.recall(_bm25_batch(spark, sf, 10), rel).withColumn("recall", F.round("recall", 6))


def _holds(spark, sf):
    """(qid, id): the documents that hold a benchmark text."""
    b, d = T(spark, sf, "benchmark"), T(spark, sf, "documents")
    return holding(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("qid"), F.col("text").alias("q")))


@query(f"""with {_BATCH_BM}, rel as (select distinct item_id as qid, doc_id as id, 1 as rel from benchmark b join documents d on strpos(d.text, b.text) > 0),
g as (select qid, sum(rel / log2(rank + 1)) as dcg from ranked join rel using (qid, id) where rank <= 10 group by qid),
i as (select qid, sum(rel / log2(n + 1)) as ideal from (select *, row_number() over (partition by qid order by rel desc, id) as n from rel) where n <= 10 group by qid)
select distinct item_id as qid, round(coalesce(dcg / ideal, 0), 6) as ndcg from benchmark left join g on item_id = g.qid left join i on item_id = i.qid where item_id in (select qid from ranked union select qid from rel)""")
def ndcg_at_10(spark, sf):
    rel = _holds(spark, sf).withColumn("rel", F.lit(1))
    return evaluate.ndcg(_bm25_batch(spark, sf, 10), rel).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""with {_POST}, q as (select distinct item_id as qid, unnest({_TOK}) as term from benchmark),
r as (select qid, doc_id as id, max(tf) as tf from q join post using (term) group by all), g as (select *, case when tf >= 2 then 2 else 1 end as rel from r)
select qid, id, rel from (select *, row_number() over (partition by qid order by rel desc, tf desc, id) as n from g) where n <= 10""")
def graded_labels(spark, sf):
    q = T(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", simple(F.col("text")).alias("tokens"))
    return evaluate.grades_of_texts(q, _texts(spark, sf))


@query(f"""with c as (select q.vec_id as qid, e.vec_id as id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) desc, e.vec_id) as rc,
  row_number() over (partition by q.vec_id order by round(list_inner_product(e.embedding::double[], q.embedding::double[]), 9) desc, e.vec_id) as rd
  from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0)
select qid, round(sum((rc <= 10 and rd <= 10)::int) / sum((rc <= 10 or rd <= 10)::int)::double, 6) as jaccard from c where rc <= 10 or rd <= 10 group by qid""")
def topk_jaccard(spark, sf):
    v = _vectors(spark, sf)
    q = v.where("id % 50 = 0")
    return evaluate.overlap(knn.knn_batch(v, q, 10, skip_self=True, digits=9), knn.knn_batch(v, q, 10, "dot", skip_self=True, digits=9)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""with {_POST}, {_bm25_sql(10)}, v as (select vec_id as id, round({_MEASURE['cosine']}, 9) as score from embeddings, {_Q} order by score desc, id limit 10)
select rank, v.id as vector, b.id as text, v.id is distinct from b.id as differs from {_RANK('v')} v full join {_RANK('bm')} b using (rank)""")
def mode_comparison(spark, sf):
    v = _vectors(spark, sf)
    tok = _tok(spark, sf)
    vec, txt = knn.knn(v, _query_vector(v), 10, digits=9), bm25.bm25(bm25.postings(tok, TERMS), bm25.stats(tok), TERMS, 10, digits=9)
    return evaluate.compared({"vector": fusion.ranked(vec), "text": fusion.ranked(txt)})


@query("""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
e as (select doc_id, unnest(w) as t, 1.0::double as x from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as t, 0.5::double as x from w),
h as (select doc_id, sha256(t) as h, x from e),
b as (select doc_id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint % 384)::int as d, sum(x) as x from h group by all)
select doc_id as id, d, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as x from b""")
def hash_embeddings(spark, sf):
    return hash_embedding(T(spark, sf, "documents"), "doc_id", digits=6).select("id", F.col("d").cast("int").alias("d"), "x")


# -- store --------------------------------------------------------------------
@query("select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("select doc_id, lang, n_chars from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_antijoin(spark, sf):
    from ..operators.filters import alive

    return alive(T(spark, sf, "documents"), T(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang", "n_chars")


@query("select doc_id, row_number() over (order by doc_id) - 1 as docid from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def compact_alive(spark, sf):
    """Live documents numbered densely: a count for each range of ids gives the offsets, so no single task orders everything."""
    live = delete_antijoin(spark, sf).select("doc_id").withColumn("part", F.floor(F.col("doc_id") / 4096))
    n = live.groupBy("part").agg(F.count("*").alias("n"))
    offset = n.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return live.withColumn("r", rank).join(offset, "part").select("doc_id", (F.col("r") + F.coalesce("before", F.lit(0))).alias("docid"))


_SEG = "seg as (select source as name, count(*) as total, count(l.doc_id) as tombstoned, count(l.doc_id) / greatest(count(*), 1)::double as ratio from documents d left join (select doc_id from labels where toxic = 1) l using (doc_id) group by source)"


def _segments(spark, sf):
    dead = T(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("dead"))
    return T(spark, sf, "documents").join(dead, "doc_id", "left").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("total"), F.count("dead").alias("tombstoned")).withColumn("ratio", F.col("tombstoned") / F.greatest("total", F.lit(1)))


@query(f"with {_SEG} select name, total, tombstoned, round(ratio, 6) as ratio, case when ratio > 0.2 then 'merge' else 'keep' end as advice from seg")
def segment_stats(spark, sf):
    return _segments(spark, sf).select("name", "total", "tombstoned", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") > 0.2, "merge").otherwise("keep").alias("advice"))


@query(f"with {_SEG} select name, row_number() over (order by ratio desc, total, name) as place from seg order by ratio desc, total, name limit 2")
def merge_candidates(spark, sf):
    from ..sources.store import merge_order

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("ratio"), "total", "name")
    return merge_order(_segments(spark, sf)).limit(2).withColumn("place", F.row_number().over(w)).select("name", "place")


_COL = f"""tok as (select doc_id, {_TOK} as t, lang from documents where doc_id not in (select doc_id from labels where toxic = 1)),
post as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by all),
st as (select count(*) as n, avg(len(t)::double) as avgdl from tok)"""


@query(f"with {_COL}, {_bm25_sql(20, where=chr(39).join(['lang = ', 'en', '']))} select 'd' || id as id, round(score, 6) as score from bm")
def collection_search(spark, sf):
    """Documents into a collection, toxic ones deleted, compaction, then a filtered text search."""
    import tempfile
    import uuid

    from ..sources.store import Database

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skeinix-")
    db = Database(spark, f"{base}/db-{uuid.uuid4().hex}")
    c = db.collection("docs", Schema(1, scalars=(("lang", "keyword"),)), analyzer("simple"))
    docs = T(spark, sf, "documents")
    c.add(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", "lang"))
    c.flush()
    c.delete(T(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")))
    c.compact()
    hits = c.search({"text": " ".join(TERMS), "topK": 20, "filter": {"lang": "en"}})
    return hits.select("id", F.round("score", 6).alias("score"))


# -- ingest -------------------------------------------------------------------
_POLICY = Policy(exclude=("**/fr/**", "**/*.bak"), types=(TypeRule("**/*.html"), TypeRule("*/de/**", "pdf"), TypeRule("*/{es,pt}/**", "text", False), TypeRule("*/en/*", "image")))
_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_NORM_PATH = f"array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s <> '' and s <> '.'), '/')"


def _paths(spark, sf):
    return T(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), "html")


@query(f"""with p as (select page_id, {_NORM_PATH} as p from pages)
select page_id, case when regexp_matches(p, '^([^/]+/)*fr(/.*)?$') or regexp_matches(p, '^([^/]+/)*[^/]*\\.bak$') then null when regexp_matches(p, '^([^/]+/)*[^/]*\\.html$') then 'text' when regexp_matches(p, '^[^/]*/de(/.*)?$') then null when regexp_matches(p, '^[^/]*/en/[^/]*$') then 'image' end as extractor,
 case when regexp_matches(p, '^([^/]+/)*fr(/.*)?$') or regexp_matches(p, '^([^/]+/)*[^/]*\\.bak$') then 'excluded' when regexp_matches(p, '^([^/]+/)*[^/]*\\.html$') then null when regexp_matches(p, '^[^/]*/de(/.*)?$') then 'disabled' when regexp_matches(p, '^[^/]*/en/[^/]*$') then null when regexp_matches(p, '^[^/]*/(es|pt)(/.*)?$') then 'disabled' else 'no_type' end as skip from p""")
def glob_classify(spark, sf):
    c = classify(F.col("path"), _POLICY)
    return _paths(spark, sf).select("page_id", c["extractor"].alias("extractor"), c["skip"].alias("skip"))


@query("""select doc_id, sha256(text) as file_sha, sha256(sha256(text) || chr(0) || 'text' || chr(0) || '1' || chr(0) || 'abc') as extract_key, sha256(text || chr(0) || 'mock:m:8') as embed_key,
substr(sha256(source), 1, 16) as project, substr(sha256(source), 1, 16) || ':' || lang || '/' || doc_id || '#0' as id from documents""")
def content_keys(spark, sf):
    sha = F.sha2("text", 256)
    project = S.project_id(F.col("source"))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    return T(spark, sf, "documents").select("doc_id", sha.alias("file_sha"), S.extract_key(sha, F.lit("text"), F.lit("1"), F.lit("abc")).alias("extract_key"), S.embed_key(F.col("text"), S.embed_model_id(F.lit("mock"), F.lit("m"), F.lit(8))).alias("embed_key"), project.alias("project"), S.doc_id(project, path, F.lit(0)).alias("id"))


@query("select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedup_by_hash(spark, sf):
    return T(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("with cache as (select distinct sha256(text) as key from documents join labels using (doc_id)) select distinct sha256(text) as embed_key from documents where sha256(text) not in (select key from cache)")
def cache_misses(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("embed_key"))
    cache = d.join(T(spark, sf, "labels"), "doc_id", "left_semi").select("embed_key")
    return ingest.cached(d, cache, "embed_key")[1]


# what was live before: the labelled documents; those of low quality then had another content, and conversations that went
_LIVE = """disk as (select 'd' || doc_id as path, sha256(text) as sha from documents),
live as (select 'd' || doc_id as path, case when quality = 0 then sha256('old') else sha256(text) end as sha, 1 + n_chars // 1000 as chunk_count from documents join labels using (doc_id) union all select 'c' || conv_id as path, sha256('gone') as sha, count(*) as chunk_count from conversations group by conv_id)"""


def _disk_live(spark, sf):
    d = T(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.sha2("text", 256).alias("content_sha256"), "n_chars")
    disk = d.select("path", "content_sha256", F.col("content_sha256").alias("extract_key"))
    old = F.when(F.col("quality") == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_sha256"))
    live = d.join(T(spark, sf, "labels"), "doc_id").select("path", old.alias("content_sha256"), old.alias("extract_key"), (1 + F.floor(F.col("n_chars") / 1000)).cast("long").alias("chunk_count"))
    gone = T(spark, sf, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")).agg(F.count("*").alias("chunk_count"))
    gone = gone.select("path", F.sha2(F.lit("gone"), 256).alias("content_sha256"), F.sha2(F.lit("gone"), 256).alias("extract_key"), "chunk_count")
    return disk, live.unionByName(gone)


_ACT = "act as (select path, d.sha, l.sha as old, chunk_count, case when l.sha is null then 'added' when d.sha is null then 'removed' when d.sha = l.sha then 'unchanged' else 'updated' end as action from disk d full join live l using (path))"


@query(f"with {_LIVE}, {_ACT} select path, action from act")
def reconcile_actions(spark, sf):
    return ingest.actions(*_disk_live(spark, sf)).select("path", "action")


@query(f"with {_LIVE}, {_ACT} select count(*) filter (action = 'added') as added, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'removed') as removed, count(*) filter (action = 'unchanged') as unchanged from act")
def sync_report(spark, sf):
    return ingest.report(ingest.actions(*_disk_live(spark, sf)))


@query(f"with {_LIVE}, {_ACT} select 'p:' || path || '#' || i as id from (select path, unnest(range(0, chunk_count)) as i from act where action in ('updated', 'removed'))")
def stale_chunks(spark, sf):
    return ingest.stale_ids(ingest.actions(*_disk_live(spark, sf)), "p")


@query(f"with {_LIVE} select path, event from (select path, case when l.sha is null then 'added' when d.sha is null then 'removed' when d.sha <> l.sha then 'updated' end as event from live l full join disk d using (path)) where event is not null")
def live_diff(spark, sf):
    disk, live = _disk_live(spark, sf)
    return ingest.diff(live, disk)


_CACHE = "cache as (select sha256(text) as key, max(epoch(ts)::bigint) as last_seen from documents left join events on doc_id = event_id group by 1), lk as (select distinct sha256(text) as key from documents join labels using (doc_id) where quality = 1)"


def _cache(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    seen = T(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").cast("long").alias("at"))
    cache = d.join(seen, "doc_id", "left").groupBy("key").agg(F.max("at").alias("last_seen"))
    live = d.join(T(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("key")
    return cache, live


@query(f"with {_CACHE} select key from cache where key not in (select key from lk)")
def gc_unreferenced(spark, sf):
    return ingest.garbage(*_cache(spark, sf), "key")


@query(f"with {_CACHE} select key from cache where key not in (select key from lk) and (select max(epoch(ts)::bigint) from events) - last_seen > 604800")
def gc_ttl(spark, sf):
    now = T(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).cast("long")).first()[0]
    return ingest.garbage(*_cache(spark, sf), "key", now, 604_800)


@query("select event_id, n, (select sum(least(60, power(2, i)))::bigint from range(0, n) t(i)) as due from (select event_id, 1 + (user_id % 9)::int as n from events)")
def dirty_backoff(spark, sf):
    e = T(spark, sf, "events").select("event_id", (1 + F.col("user_id") % 9).cast("int").alias("n"))
    return e.select("event_id", "n", ingest.backoff(F.col("n")).alias("due"))


@query("""with e as (select user_id, epoch(ts)::double as t, event_id from events),
g as (select *, coalesce(t - lag(t) over (partition by user_id order by t, event_id) > 3600, true)::int as cut from e),
s as (select *, sum(cut) over (partition by user_id order by t, event_id rows unbounded preceding) as b from g)
select user_id::varchar as user_id, row_number() over (partition by user_id order by min(t)) as batch, min(t) as first, max(t) as last, count(*) as n from s group by user_id, b""")
def session_debounce(spark, sf):
    """Bursts of a user's events an hour apart (no bound on a burst's length, which SQL couldn't express; tests cover it)."""
    e = T(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return debounced(e, "user_id", quiet=3600.0, most=1e18)


@query("""select doc_id, substr(case when strpos(text, chr(10)) > 0 and (strpos(string_split(text, chr(10))[1], ' > ') > 0 or string_split(text, chr(10))[1] = lang) then substr(text, strpos(text, chr(10)) + 1) else text end, 1, 240) as snippet, source || '/' || doc_id as path, doc_id::varchar as title from documents""")
def snippet_title(spark, sf):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return T(spark, sf, "documents").select("doc_id", S.snippet(F.col("text"), F.col("lang")).alias("snippet"), path.alias("path"), S.title(F.array().cast("array<string>"), path).alias("title"))


_ROOTS = f"roots as (select distinct regexp_extract({_PATH}, '^[^/]*(/[^/]*)?') as root from pages where regexp_extract({_PATH}, '^[^/]*/([^/]*)', 1) in ('en', 'de') union select distinct regexp_extract({_PATH}, '^[^/]*') from pages)"


@query(f"with p as (select distinct {_PATH} as path from pages), {_ROOTS} select path, (select root from roots where path = root or starts_with(path, root || '/') order by length(root) desc limit 1) as root from p")
def longest_roots(spark, sf):
    p = _paths(spark, sf).select("path").distinct()
    two = p.where(F.regexp_extract("path", "^[^/]*/([^/]*)", 1).isin("en", "de")).select(F.regexp_extract("path", "^[^/]*(/[^/]*)?", 0).alias("root"))
    return S.longest_root(p, two.unionByName(p.select(F.regexp_extract("path", "^[^/]*", 0).alias("root"))).distinct())


@query("""with i as (select page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^(www|m)\\.', '') as root, url as path from pages)
select root, path, page_id as at from (select *, row_number() over (partition by root order by page_id desc, path) as n from i) where n <= 200""")
def issues_report(spark, sf):
    i = T(spark, sf, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "^(www|m)\\.", "").alias("root"), F.col("url").alias("path"), F.col("page_id").alias("at"))
    return S.last_issues(i).select("root", "path", "at")


@query("""select page_id, case when regexp_matches(p, '\\.html$') then 'text/html' else 'application/octet-stream' end as kind, regexp_replace(regexp_replace(u, '/+$', '') || case when regexp_matches(regexp_replace(u, '/+$', ''), '/embeddings$') then '' when regexp_matches(regexp_replace(u, '/+$', ''), '/v1$') then '/embeddings' else '/v1/embeddings' end, 'x^', '') as endpoint from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as p, regexp_replace(url, '[?#].*$', '') as u from pages)""")
def url_functions(spark, sf):
    p = _paths(spark, sf).join(T(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u")), "page_id")
    return p.select("page_id", F.when(F.col("path").endswith(".html"), "text/html").otherwise(S.mime(F.col("path"))).alias("kind"), S.embeddings_url(F.col("u")).alias("endpoint"))


@query("""select event_id, case when d < 10 then 'just now' when d < 60 then d || ' seconds ago' when d < 3600 then d // 60 || ' minutes ago' when d < 172800 then d // 3600 || ' hours ago' when d < 2592000 then d // 86400 || ' days ago' else strftime(ts, '%Y-%m-%d') end as phrase, strftime(ts, '%Y-%m-%d') as day
from (select event_id, ts, (select max(floor(epoch(ts))::bigint) from events) - floor(epoch(ts))::bigint as d from events)""")
def relative_times(spark, sf):
    e = T(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").cast("long").alias("t"))
    now = e.agg(F.max("t").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", S.relative_time(F.col("t"), F.col("now")).alias("phrase"), S.date_of(F.col("t")).alias("day"))


@query()
def chunk_markdown(spark, sf):
    """Chunks of all documents; tests hold the chunker against worked cases."""
    return chunks(T(spark, sf, "documents").select("doc_id", "text"), ChunkConfig(), keep=("doc_id",)).select("doc_id", "chunk_index", "start_byte", "end_byte", F.md5("text").alias("digest"))


@query("""with s as (select doc_id, unnest(range(0, (length(text) + 499) // 500)) as i, text from documents where length(text) > 0 and strpos(text, chr(10)) = 0)
select doc_id, i::int as chunk_index, md5(substr(text, i * 500 + 1, 500)) as digest from s""")
def chunk_hard_cut(spark, sf):
    """Documents of one line, cut at 500 characters."""
    one = T(spark, sf, "documents").where("length(text) > 0 and instr(text, '\n') = 0").select("doc_id", "text")
    return chunks(one, ChunkConfig("plain", 500, 0, 0), keep=("doc_id",)).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query()
def chunk_plain(spark, sf):
    """Plain chunks of all documents, lines packed up to 500 characters and longer ones cut; tests hold it against brute force (SQL holds the documents of one line, see chunk_hard_cut)."""
    return chunks(T(spark, sf, "documents").select("doc_id", "text"), ChunkConfig("plain", 500, 0, 0), keep=("doc_id",)).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query()
def redacted(spark, sf):
    """Documents with secrets replaced; tests hold the function against worked cases."""
    return T(spark, sf, "documents").select("doc_id", F.md5(S.redact(F.col("text"))).alias("digest"))
