"""Vector measures as JVM expressions, and 8-bit quantisation.

All scores are doubles and sort descending: cosine (0 where a norm is 0), the
negated Euclidean distance, the dot product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: float | None = None) -> Column:
    """norm_b: the norm of b where it is a constant, which Spark wouldn't fold."""
    n = norm(a) * (norm(b) if norm_b is None else F.lit(float(norm_b)))
    return F.when((n == 0) | F.isnan(n) | (n == float("inf")), F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def l2(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def score(metric: str, vector: Column, query) -> Column:
    """Of a column against a constant query; a score that isn't finite is the lowest."""
    q = literal(query)
    if metric == "cosine":
        s = cosine(vector, q, math.sqrt(sum(float(x) ** 2 for x in query)))
    else:
        s = l2(vector, q) if metric == "l2" else dot(vector, q)
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), F.lit(float("-inf"))).otherwise(s)


def sq8_ranges(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: arrays low and high, the least and greatest value of each dimension (partial aggregation by position)."""
    each = df.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    rows = each.agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("r"))  # as many rows as dimensions (at most 4096)
    return rows.select(F.col("r.lo").alias("low"), F.col("r.hi").alias("high"))


def sq8_encode(vector: Column, low: Column, high: Column) -> Column:
    """Codes 0..255 by dimension, halves rounded away from zero; a constant dimension is 0; values beyond the range are clamped."""
    span = F.arrays_zip(vector.alias("v"), low.alias("lo"), high.alias("hi"))

    def code(t):
        lo, hi = t["lo"], t["hi"]
        x = F.when(hi > lo, (t["v"].cast("double") - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * 255.0).otherwise(F.lit(0.0))
        return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")

    return F.transform(span, code)


def sq8_decode(codes: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.arrays_zip(codes.alias("c"), low.alias("lo")), high, lambda t, hi: t["lo"] + t["c"] / 255.0 * (hi - t["lo"]))
