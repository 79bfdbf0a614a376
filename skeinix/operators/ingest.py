"""Incremental reconciliation of sources with an index, content caches, and their garbage collection.

Everything is joins of tables: what is on disk against what is live (full outer),
chunks against caches (left, and anti for the misses), cache keys against live
keys (anti).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import doc_id, embed_key

RETAIN = 365 * 86_400
COMPACT_DELETES, COMPACT_RATIO = 1000, 0.2
RETRY_FIRST, RETRY_MOST = 1, 60


def actions(disk: DataFrame, live: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """by and action (added, updated, unchanged, removed), with the keys of both sides: (content_sha256, extract_key), chunk_count of the live side.

    A file is unchanged if its content and its extract key are.
    """
    d = disk.select(*by, F.col("content_sha256").alias("sha"), F.col("extract_key").alias("key"))
    old = live.select(*by, F.col("content_sha256").alias("old_sha"), F.col("extract_key").alias("old_key"), "chunk_count")
    j = d.join(old, list(by), "full_outer")
    same = (F.col("sha") == F.col("old_sha")) & (F.col("key") == F.col("old_key"))
    action = F.when(F.col("old_key").isNull(), "added").when(F.col("key").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return j.withColumn("action", action)


def stale_ids(acts: DataFrame, project: str) -> DataFrame:
    """(id): of all chunks of the files that changed or went."""
    gone = acts.where("action in ('updated', 'removed') and chunk_count > 0")
    each = gone.select("path", F.explode(F.sequence(F.lit(0), F.col("chunk_count").cast("int") - 1)).alias("i"))
    return each.select(doc_id(F.lit(project), F.col("path"), F.col("i")).alias("id"))


def cached(keys: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits: the cache's rows of the keys; misses: distinct keys that the cache lacks)."""
    want = keys.select(key).distinct()
    return cache.join(want, key, "left_semi"), want.join(cache.select(key).distinct(), key, "left_anti")


def embed_cached(chunks: DataFrame, cache: DataFrame, model: str, embed) -> tuple[DataFrame, DataFrame]:
    """(chunks with embed_key and vector, new cache rows): each distinct text that the cache lacks is embedded once.

    cache: (embed_key, vector); embed: a function of a frame (embed_key, text) that adds vector.
    """
    keyed = chunks.withColumn("embed_key", embed_key(F.col("text"), F.lit(model)))
    misses = keyed.select("embed_key", "text").dropDuplicates(["embed_key"]).join(cache.select("embed_key"), "embed_key", "left_anti")
    new = embed(misses).select("embed_key", "vector")
    return keyed.join(cache.select("embed_key", "vector").unionByName(new), "embed_key"), new


def report(acts: DataFrame, embedded: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """One row of counts: added, updated, removed, unchanged (and embedded, cas_hits)."""
    n = lambda a: F.sum((F.col("action") == a).cast("long")).alias(a)
    out = acts.agg(*[n(a) for a in ("added", "updated", "removed", "unchanged")])
    for name, d in (("embedded", embedded), ("cas_hits", hits)):
        if d is not None:
            out = out.crossJoin(F.broadcast(d.agg(F.count("*").alias(name))))
    return out


def live_after(acts: DataFrame, counts: DataFrame) -> DataFrame:
    """The live table after a reconciliation; counts: (extract_key, chunk_count) of what was extracted."""
    now = acts.where("action <> 'removed'").select("path", F.col("sha").alias("content_sha256"), F.col("key").alias("extract_key"), F.col("chunk_count").alias("old"), "action")
    j = now.join(counts, "extract_key", "left")
    return j.select("path", "content_sha256", "extract_key", F.when(F.col("action") == "unchanged", F.col("old")).otherwise(F.coalesce("chunk_count", F.lit(0))).cast("long").alias("chunk_count"))


def diff(prev: DataFrame, nxt: DataFrame, key: str = "path", value: str = "extract_key") -> DataFrame:
    """(key, event): added, updated, removed between two snapshots."""
    j = prev.select(key, F.col(value).alias("a"), F.lit(True).alias("was")).join(nxt.select(key, F.col(value).alias("b"), F.lit(True).alias("is")), key, "full_outer")
    event = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return j.select(key, event.alias("event")).where("event is not null")


def diff_queued(prev: DataFrame, nxt: DataFrame, key: str = "path") -> DataFrame:
    return nxt.select(key).distinct().join(prev.select(key), key, "left_anti").withColumn("event", F.lit("queued"))


# -- garbage ------------------------------------------------------------------
def live_keys(lives: DataFrame, extracts: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (extract_key) and (embed_key) that registered projects use.

    lives: (project, extract_key); extracts: (extract_key, text) of cached chunks; models: (project, model).
    """
    ex = lives.select("extract_key").distinct()
    texts = lives.select("project", "extract_key").distinct().join(models, "project").join(extracts, "extract_key")
    return ex, texts.select(embed_key(F.col("text"), F.col("model")).alias("embed_key")).distinct()


def garbage(cache: DataFrame, live: DataFrame, key: str, now: int | None = None, retain: int = RETAIN, cascade: DataFrame | None = None) -> DataFrame:
    """Keys of the cache (key, last_seen) to delete: not live and, if ``now`` is given, last seen longer ago than ``retain``.

    A key that was never seen isn't deleted by age, unless it is in ``cascade`` (what a deleted extract held).
    """
    out = cache.join(live.select(key).distinct(), key, "left_anti")
    if now is not None:
        old = (F.lit(now) - F.col("last_seen")) > retain
        if cascade is None:
            out = out.where(F.coalesce(old, F.lit(False)))
        else:
            c = cascade.select(key).distinct().withColumn("__c", F.lit(True))
            out = out.join(c, key, "left").where(F.coalesce(old, F.lit(False)) | F.col("__c").isNotNull()).drop("__c")
    return out.select(key).distinct()


def swept(cache: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return cache.join(gone, key, "left_anti")


def touched(cache: DataFrame, seen: DataFrame, key: str, now: int) -> DataFrame:
    """The cache with last_seen set for the keys that were used."""
    s = seen.select(key).distinct().withColumn("__now", F.lit(now).cast("long"))
    return cache.join(s, key, "left").withColumn("last_seen", F.coalesce("__now", "last_seen")).drop("__now")


def needs_compaction(deletes: int, live: int, dead: int) -> bool:
    return deletes >= COMPACT_DELETES or dead / max(live, 1) >= COMPACT_RATIO


# -- retries ------------------------------------------------------------------
@dataclass
class DirtyQueue:
    """Files to try again, as a table (project, path, next_due, delay): due a second after the first look, then after 2, 4, ... 60 s."""

    table: DataFrame

    @classmethod
    def empty(cls, spark) -> DirtyQueue:
        return cls(spark.createDataFrame([], "project string, path string, next_due long, delay long"))

    def push(self, items: DataFrame) -> DirtyQueue:
        new = items.select("project", "path").distinct().join(self.table, ["project", "path"], "left_anti")
        return DirtyQueue(self.table.unionByName(new.select("project", "path", F.lit(None).cast("long").alias("next_due"), F.lit(RETRY_FIRST).cast("long").alias("delay"))))

    def pop(self, now: int) -> tuple[DataFrame, DirtyQueue]:
        """(due items, the queue after it)."""
        t = F.lit(now).cast("long")
        due = F.coalesce(F.col("next_due") <= t, F.lit(False))
        later = F.least(F.col("delay") * 2, F.lit(RETRY_MOST).cast("long"))
        nxt = self.table.select("project", "path", F.when(F.col("next_due").isNull(), t + F.col("delay")).when(due, t + later).otherwise(F.col("next_due")).alias("next_due"), F.when(due, later).otherwise(F.col("delay")).alias("delay"))
        return self.table.where(due).select("project", "path"), DirtyQueue(nxt)

    def clear(self, items: DataFrame) -> DirtyQueue:
        return DirtyQueue(self.table.join(items.select("project", "path"), ["project", "path"], "left_anti"))


def backoff(attempts: int):
    """Column: seconds until an item is due for the n-th time (n from 1) after it was first looked at."""
    n = F.lit(attempts) if isinstance(attempts, int) else attempts
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.lit(RETRY_MOST).cast("long"), F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i).cast("long")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
