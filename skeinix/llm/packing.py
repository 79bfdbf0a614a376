"""Operator 7: order-preserving packing by dynamic programming.

The documents of a partition, in their order, form one row of tokens.  Windows of
at most ``size`` tokens are cut out of it so that padding plus the penalties of
cuts inside documents is least:

    cost(j) = penalty(j) + min over i of cost(i) + size - (S_j - S_i),  S_j - S_i <= size

over the cut positions S (document ends: no penalty; sentence ends: ``at_sentence``;
within stretches without either: ``at_token``).  The minimum of cost(i) + S_i over
the sliding range is kept in a monotone queue, so the work is linear in the
positions.  The row is solved in stretches of ``stretch`` tokens; the last window
of a stretch stays open and begins the next one, so that nothing is padded for it.

No shuffle is made unless ``order`` names columns; then the documents are first
range-partitioned and sorted by them.  Null text counts as empty (one end token);
documents longer than a window fall into several pieces; an empty table gives no
rows.  Rows with equal or null keys are packed as documents of their own; other columns
are ignored, whatever their names; of cuts of equal cost the earliest is taken.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load, tokenizer_path
from .common import byte_slices, table, trimmed

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(positions: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Window ends (ascending, the last position included) of least cost.

    positions: ascending and positive, no two further apart than size.
    """
    n = len(positions)
    at, pen = positions.tolist(), penalties.tolist()
    back = [0] * n
    base = [0] * (n + 1)  # cost + position, by 1 + index; the start at 0
    queue = deque([0])
    pos = [0, *at]
    head, push, pop, popleft = 0, queue.append, queue.pop, queue.popleft
    for j in range(n):
        s = at[j]
        low = s - size
        while pos[queue[0]] < low:
            popleft()
        head = queue[0]
        back[j] = head
        b = base[head] + size + pen[j]  # cost(j) + s
        base[j + 1] = b
        while queue and base[queue[-1]] >= b:
            pop()
        push(j + 1)
    out, j = [], n
    while j:
        out.append(pos[j])
        j = back[j - 1]
    return out[::-1]


class _Packer:
    def __init__(self, size: int, at_sentence: int, at_token: int, stretch: int, sequence: int):
        self.size, self.at_sentence, self.at_token, self.stretch = size, at_sentence, at_token, stretch
        self.sequence = sequence
        self.docs: list = []  # (key, ids, ends of sentences, first token that is still to be packed)
        self.waiting = 0

    def add(self, key, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((key, ids, ends, 0))
        self.waiting += len(ids)

    def flush(self, last: bool):
        """Pieces of the windows that are closed: all, if last."""
        places, costs, base = [], [], 0
        for _, ids, ends, done in self.docs:
            n = len(ids) - done
            inner = ends[(ends > done) & (ends < len(ids))] - done
            marks = np.concatenate([[0], inner, [n]])
            wide = np.flatnonzero(np.diff(marks) > self.size // 32)
            if len(wide):
                hard = np.concatenate([np.arange(marks[i] + 16, marks[i + 1], 16) for i in wide])
                inner, cost = np.concatenate([inner, hard]), np.concatenate([np.full(len(inner), self.at_sentence), np.full(len(hard), self.at_token)])
                by = np.argsort(inner, kind="stable")
                inner, cost = inner[by], cost[by]
            else:
                cost = np.full(len(inner), self.at_sentence)
            places += [inner + base, [base + n]]
            costs += [cost, [0]]
            base += n
        if not base:
            return
        found = cuts(np.concatenate(places).astype(np.int64), np.concatenate(costs), self.size)
        if not last:
            found = found[:-1]
        left, at, window, begin = deque(self.docs), 0, 0, 0
        stop = found[-1] if found else 0
        while at < stop:
            key, ids, ends, done = left[0]
            end = found[window]
            n = min(len(ids) - done, end - at)
            yield key, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.sequence, at - begin
            at += n
            if done + n == len(ids):
                left.popleft()
            else:
                left[0] = (key, ids, ends, done + n)
            if at == end:
                window, begin = window + 1, at
                self.sequence += 1
        self.docs, self.waiting = list(left), base - at


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = 2048, end_id: int = 1, order: list[str] | None = None, at_sentence: int = 2, at_token: int = 24, stretch: int = 1 << 18) -> DataFrame:
    """Pieces (see SCHEMA); each token of each document is in exactly one, in order."""
    path = path or tokenizer_path("word_bpe_49k.json")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        bpe = load(path)
        marks = np.zeros(len(bpe.token_bytes), bool)
        for i, raw in enumerate(bpe.token_bytes):
            marks[i] = raw[-1:] in (b".", b"!", b"?")
        packer = _Packer(size, at_sentence, at_token, stretch, TaskContext.get().partitionId() << 40)

        def rows(pieces):
            if pieces := list(pieces):
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in byte_slices(batches, 1, 2 << 20):
            flat, ends = bpe.encode_flat(b.column(1).to_pylist())
            for k, ids in zip(b.column(0).to_pylist(), np.split(flat, ends)):
                packer.add(k, np.append(ids, np.uint16(end_id)), np.flatnonzero(marks[ids]) + 1)
                if packer.waiting >= stretch and (out := rows(packer.flush(False))):
                    yield out
        if out := rows(packer.flush(True)):
            yield out

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, tokens and padding tokens (none where a sequence's length is a power of two)."""
    n = F.col("n")
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(size - n)).alias("padding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
