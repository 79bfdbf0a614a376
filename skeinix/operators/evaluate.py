"""Retrieval quality: recall, nDCG, overlap of lists, graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bm25


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall): the share of the true ids (at most k of them) that were found; 1 where there are none. Both: (qid, id)."""
    f = found.where("id is not null").select("qid", "id").distinct().withColumn("hit", F.lit(1))
    t = truth.select("qid", "id").distinct().join(f, ["qid", "id"], "left").groupBy("qid").agg(F.count("id").alias("n"), F.count("hit").alias("hits"))
    return t.select("qid", F.when(F.col("n") == 0, 1.0).otherwise(F.col("hits") / F.least(F.lit(k), F.col("n"))).alias("recall"))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg): gain rel / log2(rank + 1), rank from 1, over the ideal order's; 0 where nothing is relevant. ranked: (qid, rank, id); qrels: (qid, id, rel)."""
    gain = lambda rank: F.col("rel") / F.log2(rank + 1)
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rel"), "id")
    both = ranked.select("qid", "id", "rank").join(qrels.select("qid", "id", "rel"), ["qid", "id"], "full_outer").withColumn("at", F.row_number().over(w))  # each side is computed once
    sums = both.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias("dcg"), F.sum(F.when((F.col("rel") > 0) & (F.col("at") <= k), gain(F.col("at")))).alias("ideal"))
    return sums.select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, jaccard) of two sets of lists (qid, id)."""
    both = a.select("qid", "id").distinct().withColumn("side", F.lit(1)).unionByName(b.select("qid", "id").distinct().withColumn("side", F.lit(2)))
    each = both.groupBy("qid", "id").agg(F.sum("side").alias("s"))
    return each.groupBy("qid").agg((F.sum((F.col("s") == 3).cast("int")) / F.count("*")).alias("jaccard"))


def compared(lists: dict[str, DataFrame]) -> DataFrame:
    """Lists (rank, id) of several modes side by side: rank, one id column a mode, and whether they differ."""
    out = None
    for mode, df in lists.items():
        d = df.select("rank", F.col("id").alias(mode))
        out = d if out is None else out.join(d, "rank", "full_outer")
    first, *rest = lists
    differs = F.lit(False)
    for m in rest:
        differs = differs | ~F.col(first).eqNullSafe(F.col(m))
    return out.withColumn("differs", differs)


def grades(queries: DataFrame, tok: DataFrame, titles: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(qid, id, rel): 3 where the title is the query, 2 where a query token occurs twice or more in a document, 1 where one occurs; the k best of a query.

    queries: (qid, text, tokens); tok: (docid, tokens); titles: (docid, title).
    """
    terms = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    tf = tok.select("docid", F.explode("tokens").alias("term")).groupBy("docid", "term").agg(F.count("*").alias("tf"))
    rel = terms.join(tf, "term").groupBy("qid", F.col("docid").alias("id")).agg(F.max("tf").alias("tf")).select("qid", "id", F.when(F.col("tf") >= 2, 2).otherwise(1).alias("rel"), "tf")
    if titles is not None:
        named = queries.join(titles, F.col("text") == F.col("title")).select("qid", F.col("docid").alias("id"), F.lit(3).alias("rel"), F.lit(0).cast("long").alias("tf"))
        rel = rel.unionByName(named).groupBy("qid", "id").agg(F.max("rel").alias("rel"), F.max("tf").alias("tf"))
    w = Window.partitionBy("qid").orderBy(F.desc("rel"), F.desc("tf"), "id")
    return rel.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).select("qid", "id", "rel")


def grades_of_texts(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``grades`` of all documents (docid, text) by the ``simple`` analyzer: k rows a query and task are shuffled. Where documents share an id their counts are added across tasks first."""
    if not bm25.unique_ids(docs):
        return grades(queries, bm25.tokenised(docs, key="docid"), k=k)
    return bm25.most_frequent(docs, queries, k).select("qid", "id", F.when(F.col("score") >= 2, 2).otherwise(1).alias("rel"))
