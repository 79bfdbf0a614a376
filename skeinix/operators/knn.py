"""Exact k nearest vectors, for one query or for a table of queries.

One query is a narrow expression over the vector column and a top-k that Spark
keeps per partition (TakeOrderedAndProject).  Many queries are multiplied in
blocks with NumPy: a block of queries goes to every base partition if its checked
size is small, else base shards and query blocks meet by equality; each task gives
k rows a query, and a window keeps the best of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import score, sq8_decode, sq8_encode, sq8_ranges
from ..model import TOPK_MAX, EngineError

SEND = 32 << 20  # bytes of queries that may go to every task
RESULT = "qid long, id long, score double"


def check_k(k: int) -> int:
    """Candidate lists may be longer than a result (a multiple of TOPK_MAX); SearchQuery bounds the result."""
    if not 0 <= k <= 100 * TOPK_MAX:
        raise EngineError("INVALID_ARG", f"k must lie in 0..{100 * TOPK_MAX}")
    return k


def top(df: DataFrame, k: int, by: str = "score", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(check_k(k))


def knn(df: DataFrame, query, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id", digits: int | None = None) -> DataFrame:
    """(id, score) of the k best; ties by id; vectors of another dimension or null score as zero vectors do."""
    v = F.when(F.size(vector) == len(query), F.col(vector)).otherwise(F.array(*[F.lit(0.0).cast("float")] * len(query)))
    s = score(metric, v, query)
    return top(df.select(F.col(key).alias("id"), (s if digits is None else F.round(s, digits)).alias("score")), k)


def measure(base: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(queries, base) scores in doubles."""
    d = queries @ base.T
    if metric == "dot":
        out = d
    elif metric == "cosine":
        n = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((base**2).sum(1))[None, :]
        out = np.divide(d, n, out=np.zeros_like(d), where=(n > 0) & np.isfinite(n))
    else:
        out = -np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (base**2).sum(1)[None, :] - 2 * d, 0))
        near = np.argwhere(out > -1e-3 * (1 + np.abs(queries).max(initial=0)))  # cancellation: measured directly
        for i, j in near:
            out[i, j] = -np.sqrt(((queries[i] - base[j]) ** 2).sum())
    return np.where(np.isfinite(out), out, -np.inf)


def best(ids: np.ndarray, base: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, metric: str, skip_self: bool, digits: int | None) -> pa.Table:
    out = ([], [], [])
    for at in range(0, len(qids), 256):
        s = measure(base, queries[at : at + 256], metric)
        if digits is not None:
            s = np.round(s, digits)
        for i, row in enumerate(s):
            q = qids[at + i]
            own = np.flatnonzero(ids != q) if skip_self else np.arange(len(ids))
            if len(own) > k > 0:
                cut = np.partition(row[own], len(own) - k)[len(own) - k]
                own = own[row[own] >= cut]
            own = own[np.lexsort((ids[own], -row[own]))[:k]]
            out[0].append(np.full(len(own), q))
            out[1].append(ids[own])
            out[2].append(row[own])
    cols = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
    return pa.Table.from_arrays(cols, names=["qid", "id", "score"])


def _matrix(t, column: str = "v") -> np.ndarray:
    c = t[column] if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(column))
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def knn_batch(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id", skip_self: bool = False, digits: int | None = None) -> DataFrame:
    """(qid, rank from 1, id, score): the k best of base for each row of queries (their ids long; null vectors take no part)."""
    check_k(k)
    pick = lambda d: d.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    b, q = pick(base), pick(queries)
    n, width = (q.agg(F.count("*"), F.max(F.size("v"))).first() or (0, 0))
    dims = F.size("v").alias("dim")
    if n * (width or 0) * 8 <= SEND:
        rows = q.collect()  # a checked size
        by: dict[int, tuple] = {}
        for r in rows:
            by.setdefault(len(r.v), ([], []))
            by[len(r.v)][0].append(r.id)
            by[len(r.v)][1].append(r.v)
        ready = {d: (np.array(i, np.int64), np.array(v)) for d, (i, v) in by.items()}

        def run(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                for d, (qids, qv) in ready.items():
                    own = t.filter(pa.compute.equal(t["dim"], d)) if t.num_rows else t
                    if own.num_rows:
                        yield from best(own["id"].to_numpy(), _matrix(own), qids, qv, k, metric, skip_self, digits).to_batches()

        near = b.select("id", "v", dims).mapInArrow(run, RESULT)
    else:
        shards, blocks = max(1, -(-b.count() // 16384)), -(-n // 4096)

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["qid", "id", "score"])
            return best(left["id"].to_numpy(), _matrix(left), right["id"].to_numpy(), _matrix(right), k, metric, skip_self, digits)

        side = lambda d, mine, n_mine, other, n_other: d.select("id", "v", dims, F.pmod(F.xxhash64("id"), F.lit(n_mine)).cast("int").alias(mine)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        keys = ["dim", "shard", "block"]
        near = side(b, "shard", shards, "block", blocks).groupBy(*keys).cogroup(side(q, "block", blocks, "shard", shards).groupBy(*keys)).applyInArrow(cell, RESULT)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def sq8_table(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df with codes, low and high; the one row of ranges is broadcast (two arrays of the dimension)."""
    return df.crossJoin(F.broadcast(sq8_ranges(df, vector))).withColumn("codes", sq8_encode(F.col(vector), F.col("low"), F.col("high")))


def knn_sq8(df: DataFrame, query, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id", digits: int | None = None) -> DataFrame:
    """k best by quantised vectors; the query is quantised by the same ranges."""
    from ..functions.vector import cosine, dot, l2, literal

    t = sq8_table(df, vector)
    q = sq8_decode(sq8_encode(literal(query), F.col("low"), F.col("high")), F.col("low"), F.col("high"))
    t = t.select(F.col(key).alias("id"), sq8_decode(F.col("codes"), F.col("low"), F.col("high")).alias("v"), q.alias("q"))
    s = {"cosine": cosine, "l2": l2, "dot": dot}[metric](F.col("v"), F.col("q"))
    return top(t.select("id", (s if digits is None else F.round(s, digits)).alias("score")), k)
