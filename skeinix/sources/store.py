"""Databases of collections: versioned Parquet tables and a manifest.

A database is a folder; manifest-<n>.json names the files that are live in version
n, and the newest is the database.  A flush, delete, compaction or re-index writes
new files and then one new manifest, so readers see all of a change or nothing.
Files that no manifest names are left-overs of a crash and go at ``recover``.

A collection has segments (documents, and postings in runs sorted by term) and tombstones
(docids).  Adding a document whose id exists replaces it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analyze import Analyzer, analyzer, lengths
from ..model import COMMIT_DOCS, COMMIT_MS, SEGMENT_MAX, EngineError, Schema, SearchQuery
from ..operators import bm25, search
from .fs import Files

VERSION = 1
#: Seconds after which files that no manifest names count as left over by a session that ended.
LEASE_S = 24 * 3600.0
#: Docids that are renumbered by one row, and so many of such rows (8 KB each) at most go to every task.
BUCKET, SENT_BUCKETS = 4096, 2048


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.recover()

    # -- manifests --------------------------------------------------------
    def _latest(self) -> int:
        return max((int(n[9:-5]) for n in self.files.names(self.path) if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self) -> dict:
        n = self._latest()
        if not n:
            return {"version": VERSION, "number": 0, "collections": {}}
        try:
            m = json.loads(self.files.read(f"{self.path}/manifest-{n:012d}.json"))
        except ValueError as e:
            raise EngineError("CORRUPT", f"manifest {n} can't be read") from e
        if m.get("version") != VERSION:
            raise EngineError("VERSION", f"manifest version {m.get('version')}")
        return m

    def commit(self, name: str, entry: dict | None, keep: int = 2) -> None:
        m = self.manifest()
        m["number"] += 1
        if entry is None:
            m["collections"].pop(name, None)
        else:
            m["collections"][name] = entry
        self.files.write_new(f"{self.path}/manifest-{m['number']:012d}.json", json.dumps(m))
        old = m["number"] - keep
        if old > 0:
            self.files.delete(f"{self.path}/manifest-{old:012d}.json")

    def recover(self, lease: float = LEASE_S) -> list[str]:
        """Delete what no kept manifest names and what hasn't changed for ``lease`` seconds, since it may be another session's that isn't committed yet; returns the names."""
        live: set[str] = set()
        for n in self.files.names(self.path):
            if n.startswith("manifest-") and n.endswith(".json"):
                for c in json.loads(self.files.read(f"{self.path}/{n}"))["collections"].values():
                    live |= {s["name"] for s in c["segments"]} | {s["postings"] for s in c["segments"]} | set(c["tombstones"])
        gone = [n for n in self.files.names(self.path) if n[:2] in ("s-", "p-", "t-") and n not in live] if live or self._latest() else []
        gone = [n for n in gone if time.time() - self.files.modified(f"{self.path}/{n}") >= lease] if lease > 0 else gone
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        return gone

    # -- collections ------------------------------------------------------
    def collections(self) -> list[str]:
        return sorted(self.manifest()["collections"])

    def collection(self, name: str, schema: Schema | None = None, tokens: Analyzer | None = None) -> Collection:
        """Create or reopen; a reopened one must have the same schema and analyzer."""
        entry = self.manifest()["collections"].get(name)
        tokens = tokens or analyzer((entry or {}).get("analyzer", "standard"))
        if entry is None:
            if schema is None:
                raise EngineError("NOT_FOUND", f"no collection {name}")
            entry = {"schema": schema.to_dict(), "analyzer": tokens.name, "tokenizer": tokens.id, "segments": [], "tombstones": [], "next": 0, "state": "stable"}
            self.commit(name, entry)
        elif schema is not None and schema.to_dict() != entry["schema"]:
            raise EngineError("SCHEMA", f"{name} has another schema")
        elif tokens.id != entry["tokenizer"]:
            raise EngineError("TOKENIZER_MISMATCH", f"{name} was built with another analyzer")
        return Collection(self, name, Schema.from_dict(entry["schema"]), tokens)

    def drop(self, name: str) -> None:
        self.commit(name, None)

    def stats(self) -> DataFrame:
        """A row a collection: name, segments, total, live, tombstoned, bytes, state; sorted by name."""
        rows = [(n, *self.collection_stats(n)) for n in self.collections()]
        return self.spark.createDataFrame(rows, "name string, segments long, total long, live long, tombstoned long, bytes long, state string, health string")

    def collection_stats(self, name: str) -> tuple:
        e = self.manifest()["collections"][name]
        total = sum(s["count"] for s in e["segments"])
        dead = 0
        if e["tombstones"]:  # those of documents that merges have dropped since count no more
            held = self.spark.read.parquet(*[f"{self.path}/{s['name']}" for s in e["segments"]]).select("docid")
            dead = held.join(self.spark.read.parquet(*[f"{self.path}/{t}" for t in e["tombstones"]]).distinct(), "docid", "left_semi").count()
        size = sum(self.files.size(f"{self.path}/{x}") for s in e["segments"] for x in (s["name"], s["postings"]))
        missing = [s["name"] for s in e["segments"] if not self.files.exists(f"{self.path}/{s['name']}")]
        health = "corrupt" if missing else "degraded" if e["state"] != "stable" else "healthy"
        return len(e["segments"]), total, total - dead, dead, size, e["state"], health

    def export(self, dest: str) -> None:
        """The live version as a folder of its own."""
        m = self.manifest()
        names = {x for c in m["collections"].values() for s in c["segments"] for x in (s["name"], s["postings"])} | {t for c in m["collections"].values() for t in c["tombstones"]}
        for n in sorted(names):
            self.files.copy(f"{self.path}/{n}", f"{dest}/{n}")
        self.files.write_new(f"{dest}/manifest-{max(1, m['number']):012d}.json", json.dumps(m | {"number": max(1, m["number"])}))

    @classmethod
    def restore(cls, spark: SparkSession, src: str, path: str) -> Database:
        """A database at path from an exported folder."""
        f = Files(spark)
        if f.names(path):
            raise EngineError("BUSY", f"{path} isn't empty")
        for n in f.names(src):
            f.copy(f"{src}/{n}", f"{path}/{n}")
        return cls(spark, path)


class Collection:
    def __init__(self, db: Database, name: str, schema: Schema, tokens: Analyzer):
        self.db, self.name, self.schema, self.analyzer = db, name, schema, tokens
        self.buffer: list[DataFrame] = []
        self.buffered, self.since = 0, time.monotonic()

    @property
    def spark(self) -> SparkSession:
        return self.db.spark

    @property
    def entry(self) -> dict:
        return self.db.manifest()["collections"][self.name]

    def _path(self, name: str) -> str:
        return str(PurePosixPath(self.db.path) / name) if "://" not in self.db.path else f"{self.db.path}/{name}"

    # -- writing ----------------------------------------------------------
    def add(self, docs: DataFrame, auto: bool = False) -> DataFrame:
        """Buffer rows (id, text, vector, scalars); they are seen after flush. Columns are checked and cast now; those that the schema lacks go.

        auto: count the rows and flush at 1000 rows or after a second.
        """
        if self.entry["state"] == "rebuilding":
            raise EngineError("BUSY", "the collection is being re-indexed")
        if "id" not in docs.columns:
            raise EngineError("SCHEMA", "documents need an id")
        cols = []
        for f in self.schema.struct().fields:
            if f.name not in docs.columns:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            have = docs.schema[f.name].dataType
            widened = have.typeName() in ("integer", "short", "byte", "long") and f.dataType.typeName() in ("long", "double") or have.typeName() == "float" and f.dataType.typeName() == "double"
            if f.name in self.schema.kinds() and have != f.dataType and not widened and have.typeName() != "void":
                raise EngineError("SCHEMA", f"{f.name}: {have.simpleString()} instead of {f.dataType.simpleString()}")
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        rows = docs.select(*cols)
        wrong = F.col("vector").isNotNull() & (F.size("vector") != self.schema.dim)
        rows = rows.withColumn("vector", F.when(wrong, F.raise_error(F.lit(f"SCHEMA: vectors need {self.schema.dim} dimensions")).cast("array<float>")).when(F.col("vector").isNull(), F.array_repeat(F.lit(0.0).cast("float"), self.schema.dim)).otherwise(F.col("vector")))
        self.buffer.append(rows)
        if auto:
            self.buffered += docs.count()
            if self.buffered >= COMMIT_DOCS or (time.monotonic() - self.since) * 1000 >= COMMIT_MS:
                self.flush()
        return rows

    def _numbered(self, rows: DataFrame, base: int, newest: bool = False) -> tuple[DataFrame, int, str]:
        """Rows with dense docids from base, written as a segment: one pass to write, then counts of the written parts; rows aren't shuffled.

        newest: of rows with one id that with the largest __seq stays, the last of those.
        """
        tmp = f"s-{uuid.uuid4().hex}"
        part, at = F.spark_partition_id(), F.monotonically_increasing_id()
        rows.withColumn("__p", part).withColumn("__n", at.bitwiseAND((1 << 33) - 1)).write.parquet(self._path(tmp))
        raw = self.spark.read.parquet(self._path(tmp))
        if newest:
            last = Window.partitionBy("id").orderBy(F.desc("__seq"), F.desc("__p"), F.desc("__n"))
            old = raw.select("id", "__seq", "__p", "__n").withColumn("__k", F.row_number().over(last)).where("__k > 1").select("__p", "__n")
            if not old.isEmpty():
                out = self._numbered(raw.join(old, ["__p", "__n"], "left_anti").drop("__p", "__n"), base)
                self.db.files.delete(self._path(tmp))
                return out
        counts = raw.groupBy("__p").agg(F.count("*").alias("c")).collect()  # a row a partition
        offset, begin = base, {}
        for r in sorted(counts, key=lambda r: r["__p"]):
            begin[r["__p"]] = offset
            offset += r["c"]
        table = self.spark.createDataFrame([(p, o) for p, o in begin.items()] or [(0, base)], "__p int, __o long")
        name = f"s-{uuid.uuid4().hex}"
        out = raw.join(F.broadcast(table), "__p").withColumn("docid", (F.col("__o") + F.col("__n")).cast("long")).withColumn("dl", lengths(self.analyzer.tokens)(F.col("text")))
        out.select(*[f.name for f in self.schema.struct().fields], "docid", "dl").write.parquet(self._path(name))
        self.db.files.delete(self._path(tmp))
        return self.spark.read.parquet(self._path(name)), offset - base, name

    def _renumbered(self, live: DataFrame, base: int) -> tuple[DataFrame, int, str]:
        """Live documents with dense docids from base in the order of their docids, written as a segment; they keep their lengths.

        A row for each BUCKET of old docids has those that live and the number before them; the
        texts are joined to it where they are if the table is small.
        """
        place, at = F.floor(F.col("docid") / BUCKET).alias("__b"), (F.col("docid") % BUCKET).cast("short")
        own = live.select(place, at.alias("__at")).groupBy("__b").agg(F.sort_array(F.collect_list("__at")).alias("__own"))
        own = own.withColumn("__o", F.coalesce(F.sum(F.size("__own")).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if self.entry["next"] <= BUCKET * SENT_BUCKETS:
            own = F.broadcast(own)
        name = f"s-{uuid.uuid4().hex}"
        out = live.withColumn("__b", place).join(own, "__b").withColumn("docid", (F.lit(base) + F.col("__o") + F.array_position("__own", at) - 1).cast("long"))
        out.select(*[f.name for f in self.schema.struct().fields], "docid", "dl").write.parquet(self._path(name))
        docs = self.spark.read.parquet(self._path(name))
        return docs, docs.count(), name

    def _postings(self, docs: DataFrame) -> str:
        """A file for each task's documents, in runs sorted by term, so most pages of each are skipped for a term; nothing is shuffled."""
        name = f"p-{uuid.uuid4().hex}"
        bm25.postings_of_texts(docs.select("docid", "text"), self.analyzer.tokens).write.parquet(self._path(name))
        return name

    def flush(self) -> int:
        """Make the buffered rows a segment; of rows with one id the last added stays, and what it replaces gets a tombstone."""
        if not self.buffer:
            return 0
        e = self.entry
        rows = None
        for i, b in enumerate(self.buffer):
            b = b.withColumn("__seq", F.lit(i))
            rows = b if rows is None else rows.unionByName(b)
        docs, n, name = self._numbered(rows, e["next"], newest=True)
        dead = []
        if e["segments"]:
            old = self.live().select("docid", "id").join(docs.select("id"), "id", "left_semi").select("docid")
            dead = self._tombs(old)
        segs = [*e["segments"], {"name": name, "postings": self._postings(docs), "base": e["next"], "count": n}]
        self.db.commit(self.name, e | {"segments": segs, "tombstones": [*e["tombstones"], *dead], "next": e["next"] + n})
        self.buffer, self.buffered, self.since = [], 0, time.monotonic()
        if len(segs) > SEGMENT_MAX:
            self.merge(merge_order(self.segments()).limit(2))
        return n

    def _tombs(self, docids: DataFrame) -> list[str]:
        name = f"t-{uuid.uuid4().hex}"
        docids.select("docid").write.parquet(self._path(name))
        if self.spark.read.parquet(self._path(name)).isEmpty():
            self.db.files.delete(self._path(name))
            return []
        return [name]

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Tombstone flushed documents; returns how many are newly deleted; unknown ids are ignored."""
        e = self.entry
        if not e["segments"]:
            return 0
        want = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        new = self._tombs(self.live().join(want.select("id").distinct(), "id", "left_semi").select("docid"))
        if not new:
            return 0
        self.db.commit(self.name, e | {"tombstones": [*e["tombstones"], *new]})
        return self.spark.read.parquet(self._path(new[0])).count()

    def compact(self) -> None:
        """One segment of the live documents, docids from 0; nothing to do for no segment, or one without tombstones."""
        e = self.entry
        if not e["segments"] or len(e["segments"]) == 1 and not e["tombstones"]:
            return
        docs, n, name = self._renumbered(self.live(), 0)
        self.db.commit(self.name, e | {"segments": [{"name": name, "postings": self._postings(docs), "base": 0, "count": n}], "tombstones": [], "next": n})

    def merge(self, chosen: DataFrame) -> None:
        """Merge the chosen segments (name) into one; the others stay as they are."""
        names = [r["name"] for r in chosen.select("name").collect()]  # at most SEGMENT_MAX + 1
        e = self.entry
        docs, n, name = self._renumbered(self.live().where(F.col("seg").isin(names)), e["next"])
        segs = [s for s in e["segments"] if s["name"] not in names] + [{"name": name, "postings": self._postings(docs), "base": e["next"], "count": n}]
        self.db.commit(self.name, e | {"segments": segs, "next": e["next"] + n})

    def set_user_dict(self, tokens: Analyzer) -> None:
        """Stage another analyzer; it takes effect at reindex, in this session or, by its name, in a later one."""
        self._staged = tokens
        self.db.commit(self.name, self.entry | {"state": "pending", "staged": {"analyzer": tokens.name, "tokenizer": tokens.id}})

    def reindex(self, tokens: Analyzer | None = None) -> None:
        """Build the postings anew from the stored texts with the staged analyzer.

        After a restart it is made by its name, or is ``tokens`` (an analyzer with words of
        its own has to be given); it must be the one that was staged.
        """
        e = self.entry
        if e["state"] != "pending":
            raise EngineError("INVALID_ARG", "no dictionary is staged")
        staged = tokens or getattr(self, "_staged", None) or analyzer(e["staged"]["analyzer"])
        if staged.id != e["staged"]["tokenizer"]:
            raise EngineError("TOKENIZER_MISMATCH", "another analyzer was staged")
        before, self.analyzer = self.analyzer, staged
        try:
            segs = []
            for s in e["segments"]:
                docs = self.spark.read.parquet(self._path(s["name"]))
                name = f"s-{uuid.uuid4().hex}"
                docs.withColumn("dl", lengths(self.analyzer.tokens)(F.col("text"))).write.parquet(self._path(name))
                segs.append(s | {"name": name, "postings": self._postings(docs)})
        except Exception:
            self.analyzer = before
            raise
        done = {"segments": segs, "state": "stable", "analyzer": self.analyzer.name, "tokenizer": self.analyzer.id}
        self.db.commit(self.name, {k: v for k, v in e.items() if k != "staged"} | done)
        self._staged = None

    # -- reading ----------------------------------------------------------
    def documents(self) -> DataFrame:
        """All rows of all segments: docid, dl, seg and the schema's columns."""
        parts = [self.spark.read.parquet(self._path(s["name"])).withColumn("seg", F.lit(s["name"])) for s in self.entry["segments"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema.struct()).select(F.lit(None).cast("long").alias("docid"), F.lit(None).cast("long").alias("dl"), "*", F.lit("").alias("seg"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tombstones(self) -> DataFrame | None:
        t = self.entry["tombstones"]
        return self.spark.read.parquet(*[self._path(x) for x in t]) if t else None

    def live(self) -> DataFrame:
        t = self.tombstones()
        return self.documents() if t is None else self.documents().join(t, "docid", "left_anti")

    def postings(self) -> DataFrame:
        """Of the live documents."""
        e = self.entry
        if not e["segments"]:
            return self.spark.createDataFrame([], "term string, docid long, tf long, dl long")
        post = self.spark.read.parquet(*[self._path(s["postings"]) for s in e["segments"]])
        t = self.tombstones()
        return post if t is None else post.join(t, "docid", "left_anti")

    def segments(self) -> DataFrame:
        """A row a segment: name, base, total, tombstoned, ratio, bytes."""
        e = self.entry
        rows = [(s["name"], s["base"], s["count"], self.db.files.size(self._path(s["name"])) + self.db.files.size(self._path(s["postings"]))) for s in e["segments"]]
        seg = self.spark.createDataFrame(rows, "name string, base long, total long, bytes long")
        t = self.tombstones()
        dead = self.spark.createDataFrame([], "name string, dead long") if t is None else self.documents().select("docid", F.col("seg").alias("name")).join(t, "docid", "left_semi").groupBy("name").agg(F.count("*").alias("dead"))
        dead_n = F.coalesce("dead", F.lit(0).cast("long"))
        return seg.join(dead, "name", "left").select("name", "base", "total", dead_n.alias("tombstoned"), (dead_n / F.greatest("total", F.lit(1))).alias("ratio"), "bytes")

    def search(self, query: SearchQuery | dict, approximate: bool = False) -> DataFrame:
        """(id, score, fields): fields are the JSON forms of the stored scalars."""
        q = SearchQuery.from_dict(query) if isinstance(query, dict) else query
        return search.run(self.live(), self.postings(), self.schema, self.analyzer, q, approximate=approximate)

    def search_exact(self, query: SearchQuery | dict) -> DataFrame:
        return self.search(query)

    def read(self, ids: list[str]) -> DataFrame:
        return self.live().where(F.col("id").isin(ids)).drop("docid", "dl", "seg")


def merge_order(segments: DataFrame) -> DataFrame:
    """Segments in the order in which to merge them: most tombstones first, then the smaller ones."""
    return segments.orderBy(F.desc("ratio"), "total", "name")


def with_top_k(q: SearchQuery, k: int) -> SearchQuery:
    return replace(q, top_k=k)
