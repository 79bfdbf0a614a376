"""What the operators of this subpackage share: shared storage, Arrow batches, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

U64 = np.uint64
#: Rows of text that a worker turns into Python objects at a time, and their bytes.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
#: Size of a bitmap filter that goes to every task: a megabyte, whatever the data.
BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, or (where it is unset and everything runs on one machine, as in tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.get("SKEINIX_SHARED_DIR") or os.environ.setdefault("SKEINIX_SHARED_DIR", tempfile.mkdtemp(prefix="skeinix-"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and cut from its lineage; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more deleted now, not when the driver's memory runs low."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Have the executors collect their garbage and return the heap that is then unused to the system.

    A JVM keeps the heap that it once had, which leaves the Python workers beside it too
    little of the executor's memory when a stage that works in Python follows one that
    sorted.  A task for each core, all at once, reaches every executor of an idle session;
    where such calls aren't allowed the heap stays as it is.
    """
    n = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()
    except AnalysisException:
        pass


_HOLDER: list[str] = []
_CLEAR: list[Callable[[], None]] = []


def claim(name: str) -> None:
    """Called by a worker process before it runs an operator: tables kept for another one are given back.

    Workers outlive stages, so that without this their memory would add up over a pipeline.
    """
    if _HOLDER != [name]:
        _HOLDER[:] = [name]
        for clear in _CLEAR:
            clear()
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back as soon as they are free
        trim()


def trim() -> None:
    """Give what the C library holds of freed memory back to the system."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, giving freed memory back at the end of a task: workers take turns, and those that wait would hold it."""

    def run(batches):
        yield from fn(batches)
        trim()

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of rows and bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(SLICE_ROWS, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd(n: int, seed: int = 0) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(seed * 1000 + 1, seed * 1000 + 1 + n, dtype=U64)) | U64(1)


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-windows of a row of hashes; empty where it is shorter."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, U64)
    m = odd(n, seed)
    out = h[:k] * m[0]
    for i in range(1, n):
        out += h[i : i + k] * m[i]
    return mix(out)


_T = mix(np.arange(256, dtype=U64) + U64(77))
_T_LOWER = _T.copy()
_T_LOWER[65:91] = _T[97:123]
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 19)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, U64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _drop_powers() -> None:
    _POWERS[:] = [np.ones(1, U64), np.ones(1, U64)]


_CLEAR.append(_drop_powers)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column has about ``most`` bytes (one row at least)."""
    for b in batches:
        c = b.column(column)
        ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1 + c.offset)[c.offset :].astype(np.int64) if len(c) else np.zeros(1, np.int64)
        at = 0
        while at < len(c):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def word_grid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column of texts, A-Z as a-z, one row after the other, and where each row's begin (and the last end).

    Words are what lies between bytes 9-13 and 32; the column's own bytes are used, no
    Python strings are made.  Null is as empty.
    """
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = texts.buffers()[2]
    if raw is None or ends[-1] == ends[0]:
        return np.empty(0, U64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw, np.uint8, ends[-1])[ends[0] :]
    ends = ends - ends[0]
    inside = ~_BREAK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    first[rows] |= inside[rows]
    starts = np.flatnonzero(first)
    stop = ~inside
    stop[rows] = True
    breaks = np.append(np.flatnonzero(stop | first), len(data))
    to = breaks[np.searchsorted(breaks, starts, side="right")]
    power, back = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_T_LOWER[data] * power[: len(data)], out=sums[1:])
    h = mix((sums[to] - sums[starts]) * back[starts] + (to - starts).astype(U64))
    return h, np.searchsorted(starts, ends)


def bitmap(df: DataFrame, place: Column, bits: int = BITS) -> np.ndarray:
    """Which places (numbers below bits) occur: a filter of fixed size (bits / 8 bytes), however many rows.

    It is built by partial OR on the executors; false positives are left to a later exact join.
    """
    from pyspark.sql import functions as F

    at = df.select(place.alias("b"))
    words = at.groupBy(F.expr("shiftright(b, 6) as w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int))) as v"))
    out = np.zeros(bits // 64, U64)
    for r in words.toLocalIterator():
        out[r.w] = U64(r.v & (2**64 - 1))
    return out


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{n}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def without_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with one of the rows that are alike in key (not null) and text; texts move only where there are such rows."""
    from pyspark.sql import functions as F

    at, row, n = fresh_names(df, "id", "row", "n")
    named = df.withColumn(row, F.xxhash64(F.col(text).cast("string")))
    twice = settled(named.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(at), F.col(row)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(at, F.col(row).alias(n)))
    if twice.isEmpty():
        return df
    is_one = (F.col(key) == F.col(at)) & (F.col(row) == F.col(n))
    apart = named.join(twice, is_one, "left_anti")
    again = named.join(twice, is_one, "left_semi").dropDuplicates([key, row])
    return apart.unionByName(again).select(*df.columns)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
