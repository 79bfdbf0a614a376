"""Exact Jaccard links inside groups of candidates, in blocks of bounded size.

A group of any size is cut into blocks by a hash of the member; a task gets one
pair of blocks, never the group.  Nothing is emitted per pair: a member gets the
number of its links and the root of the cell's local union-find, so the result
grows with the members alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

BLOCK = 512


def cells(members: DataFrame, group: str = "group", member: str = "id", block: int = BLOCK) -> DataFrame:
    """A row for each cell (group, i, j) in which a member is to be compared, i <= j.

    The number of blocks comes from a count with partial aggregation.
    """
    n = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    m = members.join(n, group).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    return m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*members.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each two of the sets (sorted, distinct), itself included."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), size)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    at, who = at[keep], who[keep]
    used, at = np.unique(at, return_inverse=True)
    common = np.zeros((m, m), np.float32)  # exact below 2 ** 24 common elements
    wide = max(1, (1 << 22) // m)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for low in range(0, len(used), wide):
        i, j = np.searchsorted(at, [low, low + wide])
        x = np.zeros((m, min(wide, len(used) - low)), np.float32)
        x[who[i:j], at[i:j] - low] = 1
        common += x @ x.T
    return common.astype(np.int64)


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether den * |A & B| >= num * |A | B| for each two of the sets (sorted, distinct); an empty set links with none."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = np.zeros((2, 2), np.int64)
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if min(size) * den >= num * max(size) else 0
    else:
        common = overlaps(sets)
    union = size[:, None] + size[None, :] - common
    out = (den * common >= num * union) & (common > 0)
    np.fill_diagonal(out, False)
    return out


def links(placed: DataFrame, features: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], num: int, den: int, signs: Callable | None = None) -> DataFrame:
    """placed: (group, i, j, block, id, weight, text); features: sorted distinct 64-bit features of texts, one after the other, and their bounds.

    Gives (id, n, root) for each cell in which a member has a link: n, the summed
    weights of the members linked there; root, the least member joined with it there.
    Texts travel, not features, which would take more room.  signs: where groups are
    signatures, gives those of sets and the set of each; a pair then counts only in the
    group of the least signature that it shares.
    """

    def solve(key, ids, blocks, weights, sets, marks):
        member, first = np.unique(np.concatenate(ids), return_index=True)
        if len(member) < 2:
            return None
        block, weight = np.concatenate(blocks)[first], np.concatenate(weights)[first]
        link = linked([sets[k] for k in first], num, den)
        if key[1] != key[2]:
            link &= block[:, None] != block[None, :]
        if signs is not None and link.any():
            own = np.int64(key[0]).view(np.uint64)
            link &= overlaps([m[m < own] for m in (marks[k] for k in first)]) == 0
        n = link @ weight
        if not n.any():
            return None
        label = np.arange(len(member))
        while True:  # min-label steps; member is sorted, so the least index is the least id
            new = np.minimum(label, np.where(link, label[None, :], len(label)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = n > 0
        return member[some], n[some], member[label[some]]

    def run(batches):
        found, cell = [], None
        for b in byte_slices(batches, 6):
            flat, bounds = features(b.column(6))
            held = None
            if signs is not None:
                sig, of = signs(flat, bounds)
                order = np.lexsort((sig, of))
                held = np.split(sig[order], np.searchsorted(of[order], np.arange(1, b.num_rows)))
            k = np.stack([b.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            block, who, weight = (b.column(c).to_numpy() for c in (3, 4, 5))
            for at, to in zip(cuts, cuts[1:]):
                key = tuple(k[:, at].tolist())
                if cell is None or cell[0] != key:
                    if cell is not None and (out := solve(*cell)):
                        found.append(out)
                    cell = (key, [], [], [], [], [])
                cell[1].append(who[at:to])
                cell[2].append(block[at:to])
                cell[3].append(weight[at:to])
                cell[4].extend(flat[bounds[x] : bounds[x + 1]] for x in range(at, to))
                cell[5].extend(held[at:to] if held is not None else ())
            if len(found) > 2000:
                yield _batch(*zip(*found))
                found = []
        if cell is not None and (out := solve(*cell)):
            found.append(out)
        if found:
            yield _batch(*zip(*found))

    ready = placed.select("group", "i", "j", "block", "id", F.col("weight").cast("long"), "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return ready.mapInArrow(run, "id long, n long, root long")


def _batch(ids, ns, roots) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids, ns, roots)], names=["id", "n", "root"])
