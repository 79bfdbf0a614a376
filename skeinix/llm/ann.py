"""Operator 4: approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so the largest cosine is the least distance, and
projected on ``M`` random lines; each line's projections are kept as one sorted
array.  A query widens a window round its own projection on every line (virtual
rehashing: radius R, C R, C^2 R, ...) and counts, per vector, the lines on which it
fell into the window.  Vectors with ``threshold`` collisions are verified by their
exact cosine.  A search ends when the k-th best verified distance is within R: what
is nearer would have reached the threshold with a chance set by ``SLACK``.  If that
never happens the windows come to hold everything, and the search is exact.

The base is cut into shards of a bounded size by a hash, the queries into blocks;
a task has one shard and one block of queries, and gives k rows a query.  A shard's
arrays are made once a task, for up to ``BLOCK`` queries.

Defined cases: null, zero, empty or not finite vectors and null ids take no part;
only vectors of one dimension are compared; repeated rows are one; an id with several
vectors has its best score; a query leaves out all rows of its own id; ties go to the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

M, C, SLACK, SHARD, BLOCK = 128, 1.1, 2.0, 16384, 4096
P1 = 0.6826894921370859  # of a normal number to lie within one standard deviation
RESULT = "query_id long, vec_id long, score double"


class Shard:
    """Sorted projection arrays of a set of vectors; ``verified`` counts the vectors that were compared exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.lines = np.random.default_rng(4).standard_normal((m, vectors.shape[1]))
        p = self.lines @ (vectors / self.norm[:, None]).T
        self.order = np.argsort(p, axis=1)
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.threshold = int(m * P1 - SLACK * (m * P1 * (1 - P1)) ** 0.5)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, radius: float = 0.3, together: int = 128):
        """(query, positions, cosines) of the k nearest found, for each query."""
        radii = radius * C ** np.arange(int(np.ceil(np.log(24 / radius) / np.log(C))))
        for at in range(0, len(queries), together):
            part = queries[at : at + together]
            norm = np.sqrt(np.einsum("ij,ij->i", part, part))
            centre = self.lines @ (part / norm[:, None]).T
            # where the windows of all radii end, by line, query and radius
            low = np.stack([s.searchsorted(c[:, None] - radii) for s, c in zip(self.sorted, centre)])
            high = np.stack([s.searchsorted(c[:, None] + radii, "right") for s, c in zip(self.sorted, centre)])
            for q in range(len(part)):
                yield at + q, *self._one(query_ids[at + q], part[q], norm[q], low[:, q], high[:, q], radii, k)

    def _one(self, own_id: int, query: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray, radii: np.ndarray, k: int):
        n, order = len(self.ids), self.order
        seen, tried = np.zeros(n, np.int64), self.ids == own_id
        found, score = np.empty(0, np.int64), np.empty(0)
        for i, r in enumerate(radii):
            if i:
                parts = [o[a:b] for o, a, b in zip(order, low[:, i], low[:, i - 1]) if a < b]
                parts += [o[a:b] for o, a, b in zip(order, high[:, i - 1], high[:, i]) if a < b]
            else:
                parts = [o[a:b] for o, a, b in zip(order, low[:, 0], high[:, 0]) if a < b]
            if parts:
                seen += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((seen >= self.threshold) & ~tried)
                if len(new):
                    tried[new] = True
                    self.verified += len(new)
                    s = (self.vectors[new] @ query) / (self.norm[new] * norm)
                    found, score = np.concatenate([found, new]), np.concatenate([score, s])
                    best = np.lexsort((self.ids[found], -score))[:k]
                    found, score = found[best], score[best]
            if len(found) == k and 2 - 2 * score[-1] <= r * r or tried.all():
                break
        return found, score


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim): the rows that can take part, once each."""
    v = F.col(vector).cast("array<double>")
    d = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).dropDuplicates()


def nearest(base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of base found for each row of queries, itself left out."""
    b, q = usable(base, key, vector), usable(queries, key, vector)
    shards = max(1, -(-base.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    b = b.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            get = lambda t: (t["id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))
            ids, qids = get(left), get(right)
            shard = Shard(*ids)
            for i, found, score in shard.search(*qids, k):
                out[0].append(np.full(len(found), qids[0][i]))
                out[1].append(shard.ids[found])
                out[2].append(score)
        cols = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays(cols, names=["query_id", "vec_id", "score"])

    cell = ["dim", "shard", "block"]
    near = b.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(run, RESULT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return nearest(base, base.where("vec_id % 50 = 0"))
