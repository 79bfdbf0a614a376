"""Operator 5: fuzzy line deduplication by MinHash.

Lines (cut at newlines; those without a visible character are left alone) that are
equal are one class, by 128-bit hashes.  A class gets min-hashes of its set of
8-character shingles and, from ``ROWS`` of them each, ``BANDS`` band keys: at
Jaccard 0.8 two lines miss all bands with a chance of 0.2 %.  The members of a band
bucket are compared exactly, in blocks (``verify``); buckets with the same members
are compared once.  The links found are joined by distributed union-find, and of
each component the line with the least (doc_id, line_no) stays.

Band keys that meet in a task are combined before the shuffle; the rest is sorted
by key and read as a stream, so a hot bucket needs no memory.  A key of which a task
holds more than ``HOT`` lines is spread over ``SALTS`` tasks, and a mark tells the task
that has the rows of other tasks that the key stands for itself.

Defined cases: null or empty text has no lines; a line is known by (doc_id,
line_no), so a repeated row has the same results as the first one, and
``dedup_lines`` keeps one of the rows and tells different texts of one doc_id, or of
none, apart; null doc_ids come first in order; lines of
fewer than 8 characters have one shingle, the line itself; very long lines are
taken whole; an empty table gives no rows; other columns pass through ``dedup_lines``
unchanged, whatever their names (``n_chars``, where there is one, is counted anew).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITS, U64, bitmap, claim, fresh_names, mix, odd, release, settled, slices, table, without_repeats
from .components import components
from .verify import cells, links

WIDTH, BANDS, ROWS, NUM, DEN = 8, 12, 4, 80, 100
_M, _A = odd(WIDTH, 11), (odd(BANDS * ROWS, 12) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = odd(BANDS + ROWS, 13)
_BLANK = " \t\r\x0b\x0c"
HOT, SALTS = 4096, 64


def line_ids(lines: list[str], seed: int = 42) -> np.ndarray:
    """64-bit hashes."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), seed=seed) for x in lines], U64).view(np.int64)


def features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each line, one after the other, and their bounds."""
    h, starts = shingled(lines.to_pylist())
    for part in np.split(h, starts[1:]):
        part.sort()
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new[starts] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[np.append(starts, len(h))]


def shingled(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' shingles, one line after the other (repeats included), and where each line's begin."""
    pad = "\0" * (WIDTH - 1)
    c = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(x) for x in lines], np.int64)
    n = len(c) - WIDTH + 1
    h = c[:n] * _M[0]
    for i in range(1, WIDTH):
        h += c[i : i + n] * _M[i]
    count = np.maximum(1, size - WIDTH + 1)
    begin = np.concatenate([[0], np.cumsum(size + WIDTH - 1)[:-1]])
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.repeat(begin - starts, count) + np.arange(count.sum())
    return mix(h[at]), starts


def band_keys(lines: list[str], most: int = 1 << 20) -> np.ndarray:
    """(lines, BANDS) keys; worked out for about ``most`` characters at a time, which bounds the memory."""
    ends = np.cumsum([len(x) for x in lines])
    cut = np.unique(np.append(np.searchsorted(ends, np.arange(most, ends[-1], most)), len(lines)))
    if len(cut) > 1:
        return np.concatenate([band_keys(lines[i:j], 1 << 62) for i, j in zip([0, *cut], cut) if i < j])
    h, starts = shingled(lines)
    x = (h >> U64(32)).astype(np.uint32)
    low = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    cut = np.searchsorted(starts, np.arange(0, len(x), 1 << 16))  # stretches that stay in the cache
    for i, j in zip(cut, [*cut[1:], len(lines)]):
        if i == j:
            continue
        part = x[starts[i] : starts[j] if j < len(lines) else len(x)]
        own = starts[i:j] - starts[i]
        for k in range(BANDS * ROWS):
            low[k, i:j] = np.minimum.reduceat(part * _A[k], own)
    low = low.reshape(BANDS, ROWS, -1).astype(U64)
    keys = np.repeat(_B[:BANDS, None], len(lines), axis=1)
    for r in range(ROWS):
        keys = mix(keys + low[:, r] * _B[BANDS + r])
    return keys.T


def lines_of(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """docs: (doc_id, text). (doc_id, line_no, h1, h2) of every line with a visible character; by_text: also row, a hash of the text that it is in."""

    def run(batches):
        claim("lines")
        for b in slices(batches):
            rows = [(k, n, x) for k, t in enumerate(b.column(1).to_pylist()) if t for n, x in enumerate(t.split("\n")) if x.strip(_BLANK)]
            lines = [r[2] for r in rows]
            of = pa.array(b.column(2)).take(pa.array([r[0] for r in rows], pa.int64())) if by_text else None
            cols = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array(line_ids(lines)), pa.array(line_ids(lines, 7))]
            yield pa.RecordBatch.from_arrays([*cols, *([of] * by_text)], names=["doc_id", "line_no", "h1", "h2", *(["row"] * by_text)])

    return docs.select("doc_id", "text", *([F.xxhash64("text")] * by_text)).mapInArrow(run, "doc_id long, line_no long, h1 long, h2 long" + ", row long" * by_text)


def _visible(texts) -> list[str]:
    return list({x for t in texts if t for x in t.split("\n") if x.strip(_BLANK)})


def buckets(docs: DataFrame, hot_rows: int = HOT) -> DataFrame:
    """docs: (text). Distinct (group, id): the members of band buckets that hold two lines or more."""

    def sign(batches):
        claim("lines")
        keys, ids, held = [], [], 0

        def flush():
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i = k[new].view(np.int64), i[new]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            often = k[first[size > hot_rows]]
            salt = np.zeros(len(k), np.int32)
            if len(often):
                spread = np.isin(k, often)
                salt[spread] = 1 + (mix(i[spread].view(U64)) % U64(SALTS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(np.zeros(len(often), np.int32)), pa.nulls(len(often), pa.int64())], names=["key", "salt", "id"])
            for at in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (k, salt, i)], names=["key", "salt", "id"])

        for b in slices(batches):
            lines = _visible(b.column(0).to_pylist())
            if lines:
                keys.append(band_keys(lines).ravel())
                ids.append(np.repeat(line_ids(lines), BANDS))
                held += len(keys[-1])
            if held > 500_000:
                yield from flush()
                keys, ids, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches, most=200_000):
        claim("lines")
        held_k, held_i, hot, known = np.empty(0, np.int64), np.empty(0, np.int64), None, set()

        def batch(group, ids):
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(ids, pa.int64())], names=["group", "id"])

        def closed(k, i):
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            name = mix(np.add.reduceat(mix(i.view(U64)), first) + size.astype(U64)).view(np.int64)
            many = np.repeat(size > 1, size)
            return batch(np.repeat(name, size)[many], i[many])

        for b in batches:
            if not len(b):
                continue
            key, salt, ids = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            mark = ids.is_null().to_numpy(zero_copy_only=False)  # marks come first among the rows of their keys
            known.update(key[mark].tolist())
            ids = ids.fill_null(0).to_numpy()
            pass_on = ~mark & ((salt > 0) | np.isin(key, np.array(list(known), np.int64)))
            if pass_on.any():
                yield batch(key[pass_on], ids[pass_on])
            known &= {int(key[-1])}
            k, i = key[~mark & ~pass_on], ids[~mark & ~pass_on]
            if hot is not None and len(k):
                n = int(np.searchsorted(k != hot, True)) if (k != hot).any() else len(k)
                if n:
                    yield batch(k[:n], i[:n])
                k, i = k[n:], i[n:]
                if len(k):
                    hot = None
            if not len(k):
                continue
            k, i = np.concatenate([held_k, k]), np.concatenate([held_i, i])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i = k[new], i[new]
            last = int(np.searchsorted(k != k[-1], False)) if k[0] == k[-1] else len(k) - int(np.argmax(k[::-1] != k[-1]))
            if last:
                yield closed(k[:last], i[:last])
            held_k, held_i = k[last:], i[last:]
            if len(held_k) > most:  # a hot bucket: its key is its name, and it passes as a stream
                hot = held_k[0]
                yield batch(held_k, held_i)
                held_k, held_i = held_k[:0], held_i[:0]
        if len(held_k):
            yield closed(held_k, held_i)

    signed = docs.select("text").mapInArrow(sign, "key long, salt int, id long")
    return signed.repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(meet, "group long, id long").distinct()


def texts_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(id, text), once each, of the lines whose id may be wanted (a bitmap, of a fixed size)."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches):
        claim("lines")
        mask, done = np.frombuffer(bits.value, np.uint64), set()
        for b in slices(batches):
            lines = _visible(b.column(0).to_pylist())
            ids = line_ids(lines)
            at = ids % BITS
            hit = np.flatnonzero(mask[at >> 6] >> (at & 63).astype(U64) & U64(1))
            fresh = [k for k, i in zip(hit.tolist(), ids[hit].tolist()) if i not in done]
            if len(done) < 1_000_000:
                done.update(ids[fresh].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids[fresh], pa.int64()), pa.array([lines[k] for k in fresh], pa.string())], names=["id", "text"])

    return docs.select("text").mapInArrow(run, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))


def line_components(df: DataFrame, key: str = "doc_id", text: str = "text", by_text: bool = False) -> DataFrame:
    """Per line: doc_id, line_no, first_doc_id and first_line_no (of its component), n_lines (of its component), kept.

    by_text: rows of one doc_id (or none) with different texts are told apart, by row, a hash of the text.
    """
    at = ["doc_id", "line_no", *(["row"] * by_text)]
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = settled(lines_of(docs, by_text))
    members = settled(buckets(docs))
    release(df.sparkSession)
    placed = cells(members).join(texts_of(docs, bitmap(members, F.pmod("id", F.lit(BITS)))), "id").withColumn("weight", F.lit(1).cast("long"))
    found = settled(links(placed, features, NUM, DEN))
    release(df.sparkSession)
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("n"))
    named = classes.join(joined, F.col("h1") == F.col("node"), "left").select("h1", "h2", "first", "n", F.struct(F.coalesce("component", "h1").alias("c"), F.when(F.col("component").isNull(), F.col("h2")).alias("d")).alias("c"))
    whole = named.groupBy("c").agg(F.min("first").alias("keeper"), F.sum("n").alias("n_lines"))
    per = named.join(whole, named["c"].eqNullSafe(whole["c"])).select("h1", "h2", "keeper", "n_lines")
    same = F.col("keeper.row") == F.col("row") if by_text else F.lit(True)
    return lines.join(per, ["h1", "h2"]).select(*at, F.col("keeper.doc_id").alias("first_doc_id"), F.col("keeper.line_no").alias("first_line_no"), "n_lines", (F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.line_no") == F.col("line_no")) & same).alias("kept"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the lines that aren't kept; documents that had lines and lose all of them go."""
    of, row, lost, left = fresh_names(df, "of", "row", "lost", "left")
    per = line_components(df, key, text, by_text=True)
    df = without_repeats(df, key, text)
    gone = settled(per.where("not kept").groupBy(F.col("doc_id").alias(of), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost)))
    d = df.join(gone, F.col(key).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text).cast("string")) == F.col(row)), "left")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(lost), i.cast("long")))
    d = d.withColumn(left, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n")))
    d = d.where(F.col(lost).isNull() | (F.length(F.translate(left, _BLANK + "\n", "")) > 0))
    cols = [F.col(left).alias(c) if c == text else F.length(left).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in df.columns]
    return d.select(*cols)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))
