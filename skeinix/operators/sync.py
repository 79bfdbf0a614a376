"""Reconciliation of a folder with a collection: scan, diff, extract, embed, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glob import Policy
from ..functions.strings import doc_id
from ..model import Schema
from ..sources import files
from ..sources.embed import Embedder, embedded
from . import ingest

LIVE = "path string, content_sha256 string, extract_key string, chunk_count long"
EXTRACTS = "extract_key string, text string, headings array<string>, start_byte long, end_byte long, chunk_index int, modality string"
EMBEDS = "embed_key string, vector array<float>"


def schema(dim: int) -> Schema:
    return Schema(dim, scalars=(("root", "keyword"), ("path", "keyword"), ("modality", "keyword"), ("extractor", "keyword"), ("chunk_index", "int"), ("start_byte", "int"), ("end_byte", "int")))


class Project:
    """A root, its collection, and its live table; the caches are shared by all projects of a home."""

    def __init__(self, collection, home: str, root: str, project: str, policy: Policy = Policy()):
        self.c, self.home, self.root, self.id, self.policy = collection, home.rstrip("/"), root, project, policy
        self.spark = collection.spark

    def _read(self, name: str, kind: str) -> DataFrame:
        f = self.c.db.files
        newest = [n for n in f.names(f"{self.home}/{name}") if n.startswith("v-")][-1:]
        return self.spark.read.schema(kind).parquet(f"{self.home}/{name}/{newest[0]}") if newest else self.spark.createDataFrame([], kind)

    def _write(self, name: str, df: DataFrame) -> None:
        """A new version beside the old one, which goes once the new one is whole."""
        f = self.c.db.files
        old = [n for n in f.names(f"{self.home}/{name}") if n.startswith("v-")]
        n = int(old[-1][2:]) + 1 if old else 1
        df.write.parquet(f"{self.home}/{name}/tmp-{n:012d}")
        f.copy(f"{self.home}/{name}/tmp-{n:012d}", f"{self.home}/{name}/v-{n:012d}")
        f.delete(f"{self.home}/{name}/tmp-{n:012d}")
        for o in old:
            f.delete(f"{self.home}/{name}/{o}")

    def live(self) -> DataFrame:
        return self._read(f"live-{self.id}", LIVE)

    def reconcile(self, embed: Embedder, model: str) -> dict:
        """Bring the collection up to date with the folder; returns counts."""
        scanned = files.scan(self.spark, self.root, self.policy)
        disk = files.keyed(scanned, self.policy)
        acts = ingest.actions(disk, self.live()).persist()
        fresh = disk.join(acts.where("action in ('added', 'updated')").select("path"), "path", "left_semi")
        known, missing = ingest.cached(fresh, self._read("extracts", EXTRACTS), "extract_key")
        new = files.extract(fresh.join(missing, "extract_key", "left_semi").dropDuplicates(["extract_key"]), self.policy).persist()
        chunks = fresh.select("path", "extractor", "extract_key").join(known.unionByName(new), "extract_key")
        cache = self._read("embeds", EMBEDS)
        vectors, made = ingest.embed_cached(chunks, cache, model, lambda d: embedded(d, embed))
        made = made.persist()
        counts = {r["action"]: r["count"] for r in acts.groupBy("action").count().collect()}
        counts |= {"embedded": made.count(), "chunks": vectors.count(), "skipped": scanned.where("skip is not null").count()}
        counts["cas_hits"] = chunks.select("text").distinct().count() - counts["embedded"]
        deleted = self.c.delete(ingest.stale_ids(acts, self.id))
        rows = vectors.select(doc_id(F.lit(self.id), F.col("path"), F.col("chunk_index")).alias("id"), "text", "vector", F.lit(self.root).alias("root"), "path", "modality", "extractor", F.col("chunk_index").cast("long").alias("chunk_index"), "start_byte", "end_byte")
        if counts["chunks"]:
            self.c.add(rows)
            self.c.flush()
        per = chunks.groupBy("extract_key", "path").agg(F.count("*").alias("n")).groupBy("extract_key").agg(F.max("n").alias("chunk_count"))
        after = ingest.live_after(acts, per).persist()
        after.count()
        self._write("extracts", self._read("extracts", EXTRACTS).unionByName(new))
        self._write("embeds", cache.unionByName(made))
        self._write(f"live-{self.id}", after)
        stats = self.c.db.collection_stats(self.c.name)
        if ingest.needs_compaction(deleted, stats[2], stats[3]):
            self.c.compact()
        for d in (acts, new, made, after):
            d.unpersist()
        return {a: counts.get(a, 0) for a in ("added", "updated", "removed", "unchanged", "embedded", "cas_hits", "chunks", "skipped")} | {"deleted_chunks": deleted}
