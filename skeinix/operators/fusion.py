"""Rank fusion: reciprocal ranks and min-max linear combination.

Lists are frames (qid, path, id, score) or (id, score); ranks are by score
descending, id ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import RRF_K
from .knn import top


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """With rank from 0 within ``by`` (one list, and then a small one, if none)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id")) - 1)


def rrf(lists: DataFrame, k: float = RRF_K, by: tuple[str, ...] = (), base: int = 0) -> DataFrame:
    """Sum of 1 / (k + rank + base) by id over ranked lists; an id that occurs twice in a list adds twice."""
    return lists.groupBy(*by, "id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank") + base)).alias("score"))


def minmax(score: Column, low: Column, high: Column) -> Column:
    """(score - low) / (high - low); 0 where the range is empty or not a number."""
    span = high - low
    return F.when((span > 0) & ~F.isnan(span) & (span < float("inf")), (score - low) / F.when(span > 0, span).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def normalised(df: DataFrame, *by: str) -> DataFrame:
    """With norm, the score scaled over its list."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("norm", minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w)))


def linear(vectors: DataFrame, texts: DataFrame, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """alpha * vector + (1 - alpha) * text of min-max scores over the union of ids; a missing side is 0.

    An union and one aggregation take the place of an outer join.
    """
    both = normalised(vectors, *by).select(*by, "id", F.col("norm").alias("v"), F.lit(None).cast("double").alias("t"))
    both = both.unionByName(normalised(texts, *by).select(*by, "id", F.lit(None).cast("double").alias("v"), F.col("norm").alias("t")))
    g = both.groupBy(*by, "id").agg(F.max("v").alias("v"), F.max("t").alias("t"))
    zero = F.lit(0.0)
    return g.select(*by, "id", (F.lit(float(alpha)) * F.coalesce("v", zero) + F.lit(1.0 - float(alpha)) * F.coalesce("t", zero)).alias("score"))


def fuse(vectors: DataFrame, texts: DataFrame, k: int, how: str = "rrf", alpha: float = 0.5, rrf_k: float = RRF_K) -> DataFrame:
    """(id, score) of the k best of two candidate lists (id, score)."""
    if how == "linear":
        return top(linear(vectors, texts, alpha), k)
    return top(rrf(ranked(vectors).select("id", "rank").unionByName(ranked(texts).select("id", "rank")), rrf_k), k)


def rrf_projects(lists: DataFrame, k: int) -> DataFrame:
    """Across projects: (project, id, rank from 0, degraded) lists to the k best ids by sum of 1 / (61 + rank); degraded if any of its lists is."""
    g = lists.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(61.0) + F.col("rank"))).alias("score"), F.bool_or("degraded").alias("degraded"), F.min_by("project", F.struct("list", "rank")).alias("project"))
    return top(g, k)
