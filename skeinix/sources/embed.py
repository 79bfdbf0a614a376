"""Embedding sources: texts to vectors, in batches.

An embedder is a function from a list of texts to a list of vectors; ``embedded``
runs it over a column with batches of a set size.  Built in: token hashing (an
offline default) and a constant one for tests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analyze import PIECES, Coded, Numbers
from ..model import EngineError

BATCH = 64
#: Texts whose vectors a task adds up at a time.
ROWS = 1024
Embedder = Callable[[list[str]], list[list[float]]]


def hash_vector(text: str, dim: int = 384) -> list[float]:
    """Words weigh 1 and pairs of neighbours 1/2 at the place that their SHA-256 names; scaled to length one."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    v = np.zeros(dim)
    for weight, terms in ((1.0, words), (0.5, map(" ".join, zip(words, words[1:])))):
        for t in terms:
            v[int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") % dim] += weight
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).tolist()


def hashing(dim: int = 384) -> Embedder:
    return lambda texts: [hash_vector(t, dim) for t in texts]


def zeros(dim: int, fail: bool = False) -> Embedder:
    def run(texts):
        if fail:
            raise EngineError("IO", "embedder unavailable")
        return [[0.0] * dim for _ in texts]

    return run


def ordered(response: list[dict], n: int, dim: int | None = None) -> list[list[float]]:
    """Vectors of a batch response ({index, embedding}), put in order; their number and dimension are checked."""
    if len(response) != n or sorted(r["index"] for r in response) != list(range(n)):
        raise EngineError("IO", "the embedding response doesn't match the batch")
    out = [r["embedding"] for r in sorted(response, key=lambda r: r["index"])]
    if len({len(v) for v in out} | ({dim} if dim else set())) > 1:
        raise EngineError("IO", "dim mismatch")
    return out


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", to: str = "vector", batch: int = BATCH) -> DataFrame:
    """df and the vectors of its texts (null text: as empty); batches of ``batch`` within a task."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            v = [x for i in range(0, len(texts), batch) for x in embedder(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.list_(pa.float32()))], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def _words(text: str) -> list[str]:
    return [text.lower()] if text.isascii() and text.isalnum() else re.findall("[a-z0-9]+", text.lower())


def _places(terms: list[str], dim: int) -> np.ndarray:
    sha = hashlib.sha256
    return np.frombuffer(b"".join([sha(t.encode()).digest() for t in terms]), "<u4")[::8].astype(np.int64) % dim


def hash_embedding(df: DataFrame, key: str = "id", text: str = "text", dim: int = 384, digits: int | None = None) -> DataFrame:
    """(id, d, x): the hashing embedder, sparse: the places that aren't zero; nothing is shuffled. Null or wordless texts give no rows.

    digits: to which x is rounded, halves up.
    """
    own = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        numbers = Numbers()
        coded, place = Coded(_words, numbers.__getitem__), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                if coded.full or len(numbers) >= PIECES:
                    numbers.clear()
                    coded.known.clear()
                    place = np.zeros(0, np.int64)
                row, word, _ = coded(part.column(1))
                if not len(word):
                    continue
                names = list(numbers)
                place = np.concatenate([place, _places(names[len(place) :], dim)])
                two = np.flatnonzero(row[1:] == row[:-1])
                pair, of = np.unique(word[two] * len(names) + word[two + 1], return_inverse=True)
                left, right = np.divmod(pair, len(names))
                far = _places([f"{names[i]} {names[j]}" for i, j in zip(left.tolist(), right.tolist())], dim)
                v = np.bincount(row * dim + place[word], minlength=part.num_rows * dim) + 0.5 * np.bincount(row[two] * dim + far[of], minlength=part.num_rows * dim)
                cell = np.flatnonzero(v)
                i, d = np.divmod(cell, dim)
                x = v[cell] / np.sqrt(np.bincount(i, v[cell] ** 2, part.num_rows))[i]
                if digits is not None:
                    x = np.floor(x * 10.0**digits + 0.5) / 10.0**digits
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(d), pa.array(x)], names=["id", "d", "x"])

    return own.mapInArrow(run, T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("d", T.LongType()), T.StructField("x", T.DoubleType())]))
