"""Structured Streaming forms: upserts, file events, debouncing, retries with timers.

Stateful parts are keyed (user, file), so their state is spread over the executors
and survives them in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import RETRY_FIRST, RETRY_MOST


def upserts(stream: DataFrame, collection, checkpoint: str, interval: str = "1 second", deletes: str | None = None):
    """Writes each micro-batch of documents into a collection: adds (and, where the column ``deletes`` is true, deletes) and one flush, so a batch is seen whole."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch
        if deletes:
            collection.delete(batch.where(F.col(deletes)).select("id"))
            rows = batch.where(~F.coalesce(F.col(deletes), F.lit(False))).drop(deletes)
        collection.add(rows)
        collection.flush()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def watch_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New and changed files as a stream (the source has no deletions: reconcile fully from time to time)."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)


def dirty_roots(events: DataFrame, reconcile: Callable[[str], None], checkpoint: str, quiet: str = "2 seconds"):
    """File events (root, ...) to one reconciliation of each root that a batch names."""

    def apply(batch: DataFrame, _: int) -> None:
        for r in batch.select("root").distinct().toLocalIterator():  # registered roots
            reconcile(r["root"])

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=quiet).start()


def debounced(events: DataFrame, key: str, ts: str = "ts", quiet: float = 0.5, most: float = 2.0) -> DataFrame:
    """Batches of a finite event table: (key, batch, first, last, n).

    A batch ends after ``quiet`` seconds without an event, or ``most`` seconds after its
    first one.  The second rule depends on where the batch began, so events of a key are
    walked in order; a gap of ``quiet`` cuts them into independent pieces first, which
    are spread over the tasks.
    """
    w = Window.partitionBy(key).orderBy("__t", "__e")
    e = events.select(F.col(key), F.col(ts).cast("double").alias("__t"), F.monotonically_increasing_id().alias("__e"))
    gap = (F.col("__t") - F.lag("__t").over(w)) > quiet
    cut = e.withColumn("__s", F.sum(F.coalesce(gap, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ready = cut.select(F.col(key).cast("string").alias("key"), "__s", "__t").repartition("key", "__s").sortWithinPartitions("key", "__s", "__t")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []  # (key, piece, first, last, n)
        for part in parts:
            for k, s, t in part.itertuples(index=False):
                if now is not None and now[0] == k and now[1] == s and t - now[2] <= most:
                    now[3], now[4] = t, now[4] + 1
                    continue
                if now is not None:
                    out.append((now[0], now[2], now[3], now[4]))
                now = [k, s, t, t, 1]
            if out:
                yield pd.DataFrame(out, columns=["key", "first", "last", "n"])
                out = []
        if now is not None:
            yield pd.DataFrame([(now[0], now[2], now[3], now[4])], columns=["key", "first", "last", "n"])

    pieces = ready.mapInPandas(walk, "key string, first double, last double, n long")
    return pieces.withColumn("batch", F.row_number().over(Window.partitionBy("key").orderBy("first"))).select(F.col("key").alias(key), "batch", "first", "last", "n")


def debounced_stream(events: DataFrame, key: str, ts: str = "ts", quiet: str = "500 milliseconds", delay: str = "2 seconds") -> DataFrame:
    """The streaming form by session windows: (key, first, last, n); late events beyond the watermark are dropped by it."""
    w = F.session_window(ts, quiet)
    return events.withWatermark(ts, delay).groupBy(key, w).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def retries(failures: DataFrame, output: str = "update") -> DataFrame:
    """Failures (key string, ts timestamp, ok boolean) to due retries (key, due long, attempt int), with processing-time timers.

    The first retry is due a second after a failure, then 2, 4, ... 60 seconds, until an ok arrives.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            delay, attempt, due = state.get
            out = pd.DataFrame({"key": [key[0]], "due": [due], "attempt": [attempt + 1]})
            delay = min(delay * 2, RETRY_MOST)
            state.update((delay, attempt + 1, due + delay))
            state.setTimeoutDuration(delay * 1000)
            yield out
            return
        last = None
        for part in rows:
            part = part.sort_values("ts")
            if len(part):
                last = part.iloc[-1]
        if last is not None and bool(last["ok"]):
            if state.exists:
                state.remove()
        elif not state.exists:
            due = int(last["ts"].timestamp()) + RETRY_FIRST
            state.update((RETRY_FIRST, 0, due))
            state.setTimeoutDuration(RETRY_FIRST * 1000)
        else:
            state.setTimeoutDuration(state.get[0] * 1000)

    return failures.groupBy("key").applyInPandasWithState(step, "key string, due long, attempt int", "delay int, attempt int, due long", output, "ProcessingTimeTimeout")


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a folder of logs as they are written, secrets redacted."""
    from ..functions.strings import redact

    return spark.readStream.text(folder).select(redact(F.col("value")).alias("line"))
