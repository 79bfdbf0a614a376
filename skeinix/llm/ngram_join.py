"""Operator 10: exact n-gram Jaccard self-join by PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles.  Sizes fall
into bands whose ends are (5/4)^2 apart; two sets at Jaccard 4/5 or more lie in one
band or in neighbouring ones, and each set signs for its own band and, if it can
link with a set there, for the next.

For a band, the feature domain (64-bit hashes) is cut into n partitions of equal
width and each of these into ``SUB`` = 3 parts.  Two sets that link differ in at most
k features, so of any k // 2 + 1 partitions one holds at most one difference, and
there the subset of SUB - 1 parts without it is the same in both.  A signature is a
partition, one of its subsets and what a set has in it; all subsets are enumerated.
Subsets that are empty, or lie wholly in frequent passages, don't sign: a partition
counts (is *good*) if two of its parts hold something else, since then all its
subsets sign.  A set signs for partitions in order until k // 2 + 1 of them were
good.  Of two linked sets take the one that stops first: its good partitions are
signed for by both, so they share a signature.  The few sets that run out of
partitions sign again without regard to frequency, then under other hashes, and in
the end under one common signature, so no pair can be missed.

Equal sets are one class, so copies aren't compared with each other.  Signatures
that meet within a task become star edges before the shuffle, so a frequent one
crosses it once a flush; the rest is sorted by signature and read as a stream.  The
components of these edges are compared exactly, in blocks (``verify``): a component
of at most a block whole, a larger one either whole or signature by signature,
whichever has fewer pairs; then a pair counts under the least signature that it
shares.  The links found are joined by union-find.  Classes are told apart by 128-bit
fingerprints; union-find nodes have 64 bits.

Defined cases: null, empty or blank text has the empty set: no links, a component
of its own; a null doc_id is counted as any other document, its component being
the least id known in the group; repeated rows count as documents of their own;
very long texts are taken whole; ties (equal ids in a group) change nothing but
which of the rows ``keep_one`` keeps; an empty table gives no rows; other columns are
ignored by ``ngram_join`` and pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _CLEAR, BITS, U64, bitmap, byte_slices, claim, fresh_names, mix, odd, release, settled, table, windows, without_repeats, word_grid
from .components import components
from .verify import BLOCK, cells, links

SHINGLE, NUM, DEN = 5, 80, 100
LEVELS, SUB = 8, 3
SQL = {
    "op10_ngram_join": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
e as (select x, y from c join n p on x = p.doc_id join n q on y = q.doc_id where 100 * k >= 80 * (p.n + q.n - k)),
reach as (select x, y from e union select reach.x, e.y from reach join e on reach.y = e.x),
r as (select x, min(y) as low from reach group by x), d as (select x, count(*) as m from e group by x)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(m, 0) as n_similar, least(doc_id, coalesce(low, doc_id)) as component_id
from documents left join n using (doc_id) left join d on d.x = doc_id left join r on r.x = doc_id"""
}


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text (of the whole sequence, if it is shorter), one after the other, and their bounds."""
    h, at = word_grid(texts)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    w = windows(h, n)
    flat = np.empty(bounds[-1], U64)
    for k in np.flatnonzero(size):
        a, m = at[k], count[k]
        part = flat[bounds[k] : bounds[k + 1]]
        part[:] = w[a : a + m - n + 1] if m >= n else windows(h[a : a + m], m, seed=m)
        part.sort()
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    new[bounds[:-1][size > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), n)[0]


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    size = np.diff(bounds)
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(flat ^ U64(salt)), dtype=U64)])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(U64) * odd(1, 7)[0]).view(np.int64))
    return out[0], out[1]


def distance(a: int, b: int, num: int, den: int) -> int:
    """The most features in which linked sets of sizes a and b can differ; -1: they can't link."""
    common = -(-num * (a + b) // (num + den))
    return a + b - 2 * common if common <= min(a, b) else -1


@lru_cache(maxsize=None)
def bands(num: int, den: int, size: int) -> tuple[tuple[int, int], ...]:
    """Bands (least, largest size) up to the one after that of size."""
    out, low = [], 1
    while len(out) < 2 or out[-2][0] <= size and out[-2][1] < size or out[-1][0] <= size:
        out.append((low, low * den * den // (num * num)))
        low = out[-1][1] + 1
    return tuple(out)


def _most(x: int, low: int, high: int, num: int, den: int) -> int:
    low, high = max(low, -(-num * x // den)), min(high, x * den // num)
    return max((distance(x, b, num, den) for b in range(low, high + 1)), default=-1)


@lru_cache(maxsize=None)
def _partitions(t: int, low: int, high: int, before: int, num: int, den: int) -> int:
    """Partitions of band t: enough that sets of its sizes find their number of good ones but with a chance of a few in a thousand."""
    need = 1
    for x in {max(1, -(-num * low // den)), low, (low + high) // 2, high}:
        goal = _most(x, before if x >= low else low, high, num, den) // 2 + 1
        n = max(need, goal)
        while n < 3 * goal + 8:
            empty = (1 - 1 / (SUB * n)) ** x
            good = 1 - 3 * empty**2 * (1 - empty) - empty**3
            if n * good - 2.7 * (n * good * (1 - good)) ** 0.5 >= goal:
                break
            n += 1
        need = max(need, n)
    return need


@lru_cache(maxsize=50_000)
def scheme(x: int, num: int = NUM, den: int = DEN) -> tuple[tuple[int, int, int], ...]:
    """(band, partitions, good partitions that are enough) for which a set of size x signs."""
    b, out = bands(num, den, x), []
    own = next(t for t, (low, high) in enumerate(b) if low <= x <= high)
    for t in (own, own + 1):
        low, high = b[t]
        before = b[t - 1][0] if t else low
        k = _most(x, before if t == own else low, high, num, den)
        if k > 0:
            out.append((t, _partitions(t, low, high, before, num, den), k // 2 + 1))
    return tuple(out)


def _forget() -> None:
    for f in (bands, _partitions, scheme):
        f.cache_clear()


_CLEAR.append(_forget)
_C = odd(8, 3)


def signed(flat: np.ndarray, bounds: np.ndarray, hot: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of sets (sorted features, one set after the other) and the set of each; hot: for each feature, whether its slot is a frequent one."""
    size = np.diff(bounds)
    kinds, of = np.unique(size, return_inverse=True)
    known = [scheme(int(x), num, den) if x else () for x in kinds]
    out, rows = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for role in (0, 1):
        band, parts, goal = (np.array([x[role][i] if len(x) > role else 0 for x in known], np.int64)[of] for i in range(3))
        active = np.flatnonzero(parts)
        for level in range(LEVELS):
            if not len(active):
                break
            chosen = np.zeros(len(size), bool)
            chosen[active] = True
            mask = np.repeat(chosen, size)
            own, row = flat[mask], np.repeat(active, size[active])
            seen = ~hot[mask].astype(bool) if hot is not None and not level else np.ones(len(own), bool)
            if level > 1:
                own = mix(own ^ (_C[level % 8] + U64(level)))
                own = own[np.lexsort((own, row))]
            wide = SUB * parts[row]
            cell = np.minimum(((own >> U64(11)).astype(np.float64) * (wide / 2.0**53)).astype(np.int64), wide - 1)
            at = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])]))
            sums, live = np.add.reduceat(mix(own ^ _C[0]), at), np.logical_or.reduceat(seen, at)
            row, part, sub = row[at], cell[at] // SUB, cell[at] % SUB
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
            which = np.cumsum(new) - 1
            row, part = row[new], part[new]
            held, alive = np.zeros((len(row), SUB), U64), np.zeros((len(row), SUB), bool)
            held[which, sub], alive[which, sub] = sums, live
            good = alive.sum(axis=1) > 1
            total = np.cumsum(good)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            start = np.repeat(total[first] - good[first], np.diff(np.append(first, len(row))))
            signs = (total - good - start < goal[row])[:, None] & (alive.sum(axis=1)[:, None] > alive)
            salt = mix(band[row].astype(U64) * U64(LEVELS) + U64(level)) + part.astype(U64) * _C[1]
            every = mix((held.sum(axis=1, dtype=U64)[:, None] - held) + salt[:, None] + np.arange(SUB, dtype=U64) * _C[2])
            out.append(every[signs])
            rows.append(np.repeat(row, SUB).reshape(-1, SUB)[signs])
            found = np.add.reduceat(good.astype(np.int64), first)
            active = row[first][found < goal[row[first]]]
        out.append(mix(band[active].astype(U64) * _C[3]))
        rows.append(active)
    return np.concatenate(out), np.concatenate(rows)


def signatures(items: np.ndarray, hot: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The signatures of one set."""
    return signed(items, np.array([0, len(items)]), hot, num, den)[0]


SLOTS = 23  # bits of the table of feature counts that a task keeps


def slots(items: np.ndarray) -> np.ndarray:
    return (mix(items ^ _C[5]) >> U64(64 - SLOTS)).astype(np.int64)


def marks(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """docs: (doc_id, text, row). Per row: doc_id, row, n_shingles, and the set's fingerprint (f1, f2); and the frequent slots (a bitmap of 2 ** SLOTS bits).

    A slot is frequent where some task counts far more documents in it than evenly
    spread features would put there.
    """

    def run(batches):
        claim("shingles")
        count, total, none = np.zeros(1 << SLOTS, np.int32), 0, pa.int64()
        for b in byte_slices(batches, 1):
            flat, bounds = shingle_sets(b.column(1))
            f1, f2 = fingerprints(flat, bounds)
            n = np.diff(bounds)
            _, once = np.unique(f1, return_index=True)
            first = np.zeros(len(n), bool)
            first[once] = True
            own = flat[np.repeat(first, n)]
            np.add.at(count, slots(own), 1)
            total += len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, none), pa.array(f1), pa.array(f2), pa.nulls(len(n), none)], names=["doc_id", "row", "n_shingles", "f1", "f2", "slot"])
        mean = total / len(count)
        often = np.flatnonzero(count > 4 + mean + 6 * mean**0.5)
        for at in range(0, len(often), 50_000):
            part = pa.array(often[at : at + 50_000], none)
            gone = pa.nulls(len(part), none)
            yield pa.RecordBatch.from_arrays([gone, gone, gone, gone, gone, part], names=["doc_id", "row", "n_shingles", "f1", "f2", "slot"])

    both = settled(docs.mapInArrow(run, "doc_id long, row long, n_shingles long, f1 long, f2 long, slot long"))
    return both.where("slot is null").drop("slot"), bitmap(both.where("slot is not null"), F.col("slot"), 1 << SLOTS)


def frequent_slots(flat: np.ndarray, mask: np.ndarray) -> np.ndarray:
    at = slots(flat)
    return (mask[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(np.uint8)


def _once(flat: np.ndarray, bounds: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sets, their bounds and first fingerprints."""
    order = np.lexsort((f2, f1))
    new = np.concatenate([[True], (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])]) if len(f1) else np.empty(0, bool)
    keep = np.zeros(len(f1), bool)
    keep[order[new]] = True
    size = np.diff(bounds)
    return flat[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), f1[keep]


def _stars(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (sig, who): positions of the first row of each signature, and the star edges within them."""
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    head = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
    edge = who != head
    return first, who[edge], head[edge]


def candidate_edges(docs: DataFrame, frequent: np.ndarray, num: int = NUM, den: int = DEN) -> DataFrame:
    """Star edges (a, b) between classes (f1) that share a signature; frequent: the bitmap that ``marks`` gives."""
    bits = docs.sparkSession.sparkContext.broadcast(frequent.tobytes())

    def sign(batches):
        claim("shingles")
        sigs, ids, held = [], [], 0

        def flush():
            sig, who = np.concatenate(sigs), np.concatenate(ids)
            order = np.argsort(sig, kind="stable")
            first, a, b = _stars(sig[order], who[order])
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            lead = np.zeros(len(sig), bool)
            lead[order[first]] = True  # sent in the order of the documents: repeated ids compress well
            n = int(lead.sum())
            key = np.concatenate([sig[lead].view(np.int64), pairs[:, 0]])
            x = np.concatenate([who[lead], pairs[:, 0]])
            y = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 1], pa.int64())])
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000], pa.int64()), pa.array(x[at : at + 100_000], pa.int64()), y[at : at + 100_000]], names=["key", "a", "b"])

        mask = np.frombuffer(bits.value, np.uint64)
        for batch in byte_slices(batches, 0):
            flat, bounds = shingle_sets(batch.column(0))
            f1, f2 = fingerprints(flat, bounds)
            flat, bounds, f1 = _once(flat, bounds, f1, f2)
            sig, of = signed(flat, bounds, frequent_slots(flat, mask), num, den)
            sigs.append(sig)
            ids.append(f1[of])
            held += len(sig)
            if held > 250_000:
                yield from flush()
                sigs, ids, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches):
        claim("shingles")
        last_sig, last_head = None, None
        for batch in batches:
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, y = [a[known]], [batch.column(2).drop_null().to_numpy()]
            key, a = key[~known], a[~known]
            if len(key):
                first = np.concatenate([[True], key[1:] != key[:-1]])
                head = a[np.flatnonzero(first)[np.cumsum(first) - 1]]
                if last_sig is not None and key[0] == last_sig:
                    head[: len(key) if first.sum() == 1 else np.flatnonzero(first)[1]] = last_head
                last_sig, last_head = key[-1], head[-1]
                edge = a != head
                x.append(a[edge])
                y.append(head[edge])
            pairs = np.unique(np.stack([np.concatenate(x), np.concatenate(y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    rows = docs.select("text").mapInArrow(sign, "key long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def texts_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, f1, f2, text) of the rows whose doc_id may be wanted (a bitmap, of a fixed size)."""
    sc = docs.sparkSession.sparkContext
    bits = sc.broadcast(wanted.tobytes())

    def run(batches):
        claim("shingles")
        mask = np.frombuffer(bits.value, np.uint64)
        for b in byte_slices(batches, 1):
            at = b.column(2).to_numpy()
            b = b.filter(pa.array(mask[at >> 6] >> (at & 63).astype(U64) & U64(1) > 0))
            if b.num_rows:
                flat, bounds = shingle_sets(b.column(1))
                f1, f2 = fingerprints(flat, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1), pa.array(f2), b.column(1)], names=["doc_id", "f1", "f2", "text"])

    return docs.select("doc_id", "text", _place(F.col("doc_id")).alias("at")).mapInArrow(run, "doc_id long, f1 long, f2 long, text string")


def by_signature(large: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """large: (group, id, text). (group, key, id): each signature of the sets of large components."""
    bits = large.sparkSession.sparkContext.broadcast(frequent.tobytes())

    def run(batches):
        claim("shingles")
        mask = np.frombuffer(bits.value, np.uint64)
        for b in byte_slices(batches, 2):
            flat, bounds = shingle_sets(b.column(2))
            sig, of = signed(flat, bounds, frequent_slots(flat, mask), num, den)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(sig.view(np.int64)), b.column(1).take(at)], names=["group", "key", "id"])

    return large.select("group", "id", "text").mapInArrow(run, "group long, key long, id long")


def compared(members: DataFrame, texts: DataFrame, frequent: np.ndarray, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(id, n, root) of links inside candidate components (see ``verify.links``); members: (group, id, f2, rep, weight), texts: (id, f2, doc_id, text)."""

    def texted(rows: DataFrame) -> DataFrame:
        r = rows.withColumnRenamed("id", "m").withColumnRenamed("f2", "mf")
        return r.join(texts, (F.col("m") == F.col("id")) & (F.col("mf") == F.col("f2")) & F.col("rep").eqNullSafe(F.col("doc_id"))).drop("m", "mf", "rep", "doc_id")

    large = settled(members.groupBy("group").count().where(F.col("count") > block))
    if large.isEmpty():
        return settled(links(texted(cells(members, block=block)), shingle_sets, num, den))
    big = members.join(large.select("group"), "group", "left_semi")
    signed_rows = settled(by_signature(texted(big), frequent, num, den))
    pairs = signed_rows.groupBy("group", "key").agg(F.count("*").cast("double").alias("c")).where("c > 1").groupBy("group").agg(F.sum(F.col("c") * F.col("c")).alias("cost"))
    sparse = settled(large.join(pairs, "group").where(F.col("cost") < F.col("count").cast("double") * F.col("count")).select("group"))
    whole = settled(links(texted(cells(members.join(sparse, "group", "left_anti"), block=block)), shingle_sets, num, den))
    own = signed_rows.join(sparse, "group", "left_semi").select("key", "id").distinct()
    shared = own.groupBy("key").count().where(F.col("count") > 1).select("key")
    own = own.join(shared, "key", "left_semi").join(big.drop("group"), "id").withColumnRenamed("key", "group")
    bits = members.sparkSession.sparkContext.broadcast(frequent.tobytes())

    def signs(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return signed(flat, bounds, frequent_slots(flat, np.frombuffer(bits.value, np.uint64)), num, den)

    return whole.unionByName(settled(links(texted(cells(own, block=block)), shingle_sets, num, den, signs)))


def _judged(df: DataFrame, key: str, text: str, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Per row of df: doc_id, row (a hash of the text), n_shingles, n_similar, component_id, and component, which tells groups apart (null without words)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    m, frequent = marks(docs)
    classes = m.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    groups = settled(components(candidate_edges(docs, frequent, num, den)))
    release(df.sparkSession)
    members = settled(classes.join(groups, F.col("f1") == F.col("node")).select(F.col("component").alias("group"), F.col("f1").alias("id"), "f2", "rep", "weight"))
    texts = texts_of(docs, bitmap(members, _place(F.col("rep")))).withColumnRenamed("f1", "id")
    found = compared(members, texts, frequent, num, den, block)
    release(df.sparkSession)
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = classes.join(n.withColumnRenamed("id", "f1"), "f1", "left").join(joined.withColumnRenamed("node", "f1"), "f1", "left")
    per = per.withColumn("component", F.coalesce("component", "f1"))
    lowest = per.groupBy("component").agg(F.min("rep").alias("component_id"))
    per = per.join(lowest, "component").select("f1", "f2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_similar"), "component_id", "component")
    return m.join(per, ["f1", "f2"], "left").select("doc_id", "row", "n_shingles", F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def ngram_join(df: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """Per row of df: doc_id, n_shingles, n_similar, component_id."""
    return _judged(df, key, text, num, den, block).select("doc_id", "n_shingles", "n_similar", "component_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of df but for one (the least id) of each group of linked documents; columns as they were.

    A row is told by its id and its text, so rows that share an id but not the text fare
    apart.  Rows without words or without an id stay; of rows that are alike in id and
    text one stays.
    """
    at, row = fresh_names(df, "id", "row")
    r = settled(_judged(df, key, text, num, den).where("doc_id is not null and component is not null").select("doc_id", "row", "component", "n_similar"))
    linked = r.where("n_similar > 0")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    gone = settled(linked.join(first, "component").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("row") != F.col("first.row"))).select(F.col("doc_id").alias(at), F.col("row").alias(row)).distinct())
    df = without_repeats(df, key, text)
    return df.join(gone, (F.col(key).cast("long") == F.col(at)) & (F.xxhash64(F.col(text).cast("string")) == F.col(row)), "left_anti")
