"""Approximate vector search over an inverted file.

Vectors are assigned to the nearest of ``lists`` centroids (k-means on a bounded
sample); a search scans the lists whose centroids are nearest to the query and
ranks what it finds exactly.  How many lists that takes is measured: queries from the
sample, and the query itself, are held against all of it, and ``RECALL`` of the nearest
has to be found.  A filter applies before, and if few rows pass, the plan is the exact
scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import score
from .knn import check_k, knn, measure, top

SAMPLE = 20_000
#: The share of the nearest to be found, the share of queries for which that holds, and the number of queries it is measured on.
RECALL, SURE, QUERIES = 0.9, 0.95, 256


class Inverted:
    """Centroids, at most a few thousand vectors, on the driver, and the sample they come from (of so many rows)."""

    def __init__(self, centroids: np.ndarray, metric: str = "cosine", sample: np.ndarray | None = None, rows: int = 0):
        self.centroids, self.metric, self.sample, self.rows = centroids, metric, sample, rows

    @classmethod
    def train(cls, df: DataFrame, vector: str = "vector", metric: str = "cosine", lists: int | None = None, seed: int = 7, rounds: int = 12) -> Inverted:
        """k-means on at most SAMPLE vectors, taken by a hash so that every run sees the same."""
        n = df.count()
        lists = lists or max(1, min(4096, int(math.sqrt(max(1, n)))))
        share = min(1.0, SAMPLE / max(1, n))
        rows = df.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select(F.col(vector).cast("array<double>").alias("v")).limit(2 * SAMPLE).collect()
        x = np.array([r.v for r in rows], float)
        if not len(x):
            return cls(np.zeros((1, 1)), metric)
        if metric == "cosine":
            x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)
            for k in range(len(c)):
                if (at == k).any():
                    c[k] = x[at == k].mean(0)
        return cls(c, metric, x, n)

    def assigned(self, df: DataFrame, vector: str = "vector", to: str = "list") -> DataFrame:
        """df with the list of each vector; write it partitioned or sorted by that to read few lists."""
        at, c, metric = df.columns.index(vector), self.centroids, self.metric

        def run(batches):
            for b in batches:
                v = [np.zeros(c.shape[1]) if x is None or len(x) != c.shape[1] else x for x in b.column(at).to_pylist()]
                x = np.array(v, float).reshape(-1, c.shape[1])
                if metric == "cosine":
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1) if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, to])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.IntegerType())]))

    def lists(self, query, k: int, passing: int | None = None) -> int:
        """The number of lists to scan for the k best of the rows (or of those that pass a filter): what queries from the sample need, more if this one does; all, if it can't be measured."""
        c, x, q = self.centroids, self.sample, self._scaled(query)
        rows = self.rows if passing is None else passing
        if x is None or len(x) < 2 or len(q) != x.shape[1] or rows < 2 * k:
            return len(c)
        near = min(len(x) - 1, max(math.ceil(k * len(x) / max(1, rows)), min(k, 10), 1))  # so many of the sample lie as near
        at = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)

        def need(q: np.ndarray, own: int | None = None) -> int:
            s = measure(x, q[None, :], self.metric)[0]
            if own is not None:
                s[own] = -np.inf
            place = np.empty(len(c), int)
            place[self._order(q)] = np.arange(len(c))
            return 1 + int(np.sort(place[at[np.argpartition(-s, near - 1)[:near]]])[math.ceil(RECALL * near) - 1])

        usual = [need(x[i], i) for i in np.unique(np.linspace(0, len(x) - 1, QUERIES).astype(int))]
        return max(need(q), int(np.quantile(usual, SURE, method="higher")))

    def _scaled(self, query) -> np.ndarray:
        q = np.array(query, float)
        return q / max(np.sqrt((q * q).sum()), 1e-12) if self.metric == "cosine" else q

    def _order(self, q: np.ndarray) -> np.ndarray:
        d = -(self.centroids @ q) if self.metric == "dot" else ((self.centroids - q) ** 2).sum(1)
        return np.argsort(d, kind="stable")

    def probe(self, query, share: float = 0.5, lists: int | None = None) -> list[int]:
        """The lists to scan: the nearest ones, at least the share of all (or so many)."""
        order = self._order(self._scaled(query))
        return order[: max(1, math.ceil(share * len(order)) if lists is None else lists)].tolist()


def ann(assigned: DataFrame, index: Inverted, query, k: int, share: float | None = None, vector: str = "vector", key: str = "id", allowed=None, digits: int | None = None) -> DataFrame:
    """(id, score): as knn, over the probed lists, a share of all or as many as was measured; exact if fewer than 2 k rows pass the filter (a column)."""
    check_k(k)
    passing = None
    if allowed is not None:
        assigned = assigned.where(allowed)
        passing = (assigned.limit(2 * k) if share is not None else assigned).count()
        if passing < 2 * k:
            return knn(assigned, query, k, index.metric, vector, key, digits)
    probed = index.probe(query, lists=index.lists(query, k, passing)) if share is None else index.probe(query, share)
    near = assigned.where(F.col("list").isin(probed))
    s = score(index.metric, F.col(vector), query)
    return top(near.select(F.col(key).alias("id"), (s if digits is None else F.round(s, digits)).alias("score")), k)
