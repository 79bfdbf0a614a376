"""Collections, reconciliation and streams end to end."""

import pytest
from pyspark.sql import functions as F

from skeinix.functions.analyze import analyzer
from skeinix.model import EngineError, Schema
from skeinix.operators import search
from skeinix.operators.sync import Project, schema
from skeinix.sources.embed import hashing, zeros
from skeinix.sources.store import Database
from skeinix.streaming import streams

DOCS = "id string, text string, vector array<float>, lang string, year long"
SCHEMA = Schema(2, scalars=(("lang", "keyword"), ("year", "int")))


def hits(df):
    return [(r.id, round(r.score, 6)) for r in df.collect()]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def test_collection_life(spark, db, tmp_path):
    c = db.collection("docs", SCHEMA, analyzer("simple"))
    first = spark.createDataFrame([("a", "red fox", [1.0, 0.0], "en", 2020), ("b", "blue fox fox", [0.0, 1.0], "en", 2021), ("c", None, None, "de", None)], DOCS)
    c.add(first)
    assert c.live().count() == 0  # nothing is seen before a flush
    assert c.flush() == 3 and db.collections() == ["docs"]
    r = c.search({"text": "fox", "vector": [1, 0], "topK": 3}).collect()
    assert [x.id for x in r][0] in ("a", "b") and r[0].fields["lang"] == '"en"' and r[0].fields["year"] in ("2020", "2021")
    assert [i for i, _ in hits(c.search({"vector": [1, 0]}))] == ["a", "b", "c"]  # no vector: a zero vector, score 0
    assert [i for i, _ in hits(c.search({"text": "fox", "filter": {"year": {"gte": 2021}}}))] == ["b"]
    assert hits(c.search({"text": "fox", "vector": [0, 1], "filter": {"lang": "xx"}})) == []
    c.add(spark.createDataFrame([("a", "green", [1.0, 0.0], "fr", 2024), ("d", "fox", [1.0, 1.0], "fr", 2024)], DOCS))
    c.flush()  # replaces a
    assert sorted(x.id for x in c.live().collect()) == ["a", "b", "c", "d"] and [i for i, _ in hits(c.search({"text": "red"}))] == []
    assert c.delete(["b", "nope"]) == 1 and c.delete(["b"]) == 0
    before = hits(c.search({"text": "fox green", "vector": [1, 0]}))
    stats = db.stats().first()
    assert (stats.segments, stats.total, stats.live, stats.tombstoned, stats.health) == (2, 5, 3, 2, "healthy")
    assert [r.tombstoned for r in c.segments().orderBy("base").collect()] == [2, 0]
    db.export(str(tmp_path / "out"))
    again = Database.restore(spark, str(tmp_path / "out"), str(tmp_path / "copy")).collection("docs", SCHEMA, analyzer("simple"))
    assert hits(again.search({"text": "fox green", "vector": [1, 0]})) == before
    c.compact()
    assert hits(c.search({"text": "fox green", "vector": [1, 0]})) == before
    assert sorted(r.docid for r in c.documents().collect()) == [0, 1, 2]
    assert Database(spark, db.path).recover() == []
    with pytest.raises(EngineError):
        db.collection("docs", Schema(3))
    with pytest.raises(EngineError) as e:
        db.collection("docs", SCHEMA, analyzer("standard"))
    assert e.value.name == "TOKENIZER_MISMATCH"
    with pytest.raises(EngineError):
        c.add(spark.createDataFrame([("x", "not an int")], "id string, year string"))
    with pytest.raises(EngineError):
        c.search({"vector": [1, 2, 3]})
    with pytest.raises(EngineError):
        c.reindex()
    c.set_user_dict(analyzer("cjk_bigram"))
    c.reindex()
    assert db.collection("docs", tokens=analyzer("cjk_bigram")).entry["state"] == "stable"
    assert len(hits(c.search({"text": "fox", "vector": [1, 0]}, approximate=True))) == 3


def test_recovery_leaves_a_live_writer_alone(spark, db):
    """Opening the database beside a flush that isn't committed yet deletes nothing of it; what is left over goes after the lease."""
    c = db.collection("docs", Schema(1), analyzer("simple"))
    c.add(spark.createDataFrame([("a", "fox")], "id string, text string"))
    c.flush()
    spark.range(3).selectExpr("id as docid").write.parquet(f"{db.path}/s-writing")
    other = Database(spark, db.path)
    assert other.files.exists(f"{db.path}/s-writing") and other.recover() == []
    assert spark.read.parquet(f"{db.path}/s-writing").count() == 3
    assert other.recover(0) == ["s-writing"] and c.live().count() == 1


def test_staged_analyzer_outlives_the_session(spark, db):
    c = db.collection("docs", Schema(1), analyzer("simple"))
    c.add(spark.createDataFrame([("a", "foxes run"), ("b", "hen")], "id string, text string"))
    c.flush()
    c.set_user_dict(analyzer("standard"))
    again = Database(spark, db.path).collection("docs")
    with pytest.raises(EngineError):
        again.reindex(analyzer("cjk_bigram"))
    again.reindex()
    assert again.entry["state"] == "stable" and [i for i, _ in hits(again.search({"text": "fox"}))] == ["a"]
    with pytest.raises(EngineError):
        again.reindex()


def test_stats_after_a_merge(spark, db):
    c = db.collection("docs", Schema(1), analyzer("simple"))
    for i in range(3):
        c.add(spark.createDataFrame([(f"d{i}", f"w{i}"), (f"e{i}", "x")], "id string, text string"))
        c.flush()
    c.delete(["d0", "d1"])
    c.merge(c.segments().where("tombstoned > 0").limit(2))
    r = db.stats().first()
    assert (r.total, r.live, r.tombstoned) == (4, 4, 0) and c.live().count() == 4


def test_auto_merge(spark, db):
    c = db.collection("m", Schema(1), analyzer("simple"))
    for i in range(11):
        c.add(spark.createDataFrame([(f"d{i}", f"w{i}")], "id string, text string"))
        c.flush()
    assert len(c.entry["segments"]) == 10 and c.live().count() == 11
    assert [i for i, _ in hits(c.search({"text": "w3"}))] == ["d3"]


def test_reconcile_folder(spark, db, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Fox\n\nthe red fox runs\n")
    (root / "sub" / "b.txt").write_text("blue whale")
    (root / "c.bin").write_bytes(b"\xff")
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (root / "pic.png").write_bytes(b"123")
    c = db.collection("p", schema(16), analyzer("standard"))
    p = Project(c, str(tmp_path / "home"), str(root), "pid")
    r = p.reconcile(hashing(16), "hash:h:16")
    assert (r["added"], r["embedded"], r["skipped"]) == (3, 3, 2)
    r = p.reconcile(hashing(16), "hash:h:16")
    assert (r["added"], r["unchanged"], r["embedded"], r["deleted_chunks"]) == (0, 3, 0, 0)
    (root / "sub" / "b.txt").rename(root / "moved.txt")
    (root / "pic.png").unlink()
    r = p.reconcile(hashing(16), "hash:h:16")
    assert (r["added"], r["removed"], r["embedded"], r["cas_hits"]) == (1, 2, 0, 1)  # a move embeds nothing
    (root / "a.md").write_text("# Fox\n\nthe grey fox sleeps\n")
    assert p.reconcile(hashing(16), "hash:h:16")["updated"] == 1
    got = search.project_search(c, "fox", hashing(16))
    assert [x.id for x in got.collect()][0] == "pid:a.md#0" and not got.first().degraded
    assert search.project_search(c, "fox", zeros(16, fail=True)).first().degraded
    both = search.search_all({"one": c, "two": c}, "fox", {"one": hashing(16), "two": hashing(16)})
    assert both.first().id == "pid:a.md#0"
    shown = search.display(search.project_search(c, "fox", hashing(16), extractor="text"), c.live().select(F.lit("pid").alias("project"), "path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.array(F.lit("Fox")).alias("headings")))
    assert shown.where("id = 'pid:a.md#0'").first().snippet.startswith("# Fox")


def test_streams(spark, db, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("a", "fox", False), ("b", "hen", False)], "id string, text string, gone boolean").write.parquet(str(src / "1"))
    c = db.collection("s", Schema(1), analyzer("simple"))
    stream = spark.readStream.schema("id string, text string, gone boolean").option("recursiveFileLookup", True).parquet(str(src))
    q = streams.upserts(stream, c, str(tmp_path / "ck"), "0 seconds", deletes="gone")
    q.processAllAvailable()
    spark.createDataFrame([("a", "cow", False), ("b", None, True)], "id string, text string, gone boolean").write.parquet(str(src / "2"))
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.text) for r in c.live().collect()] == [("a", "cow")]
    e = spark.createDataFrame([("u", t) for t in (0.0, 0.4, 0.8, 1.2, 1.6, 2.0, 2.4, 5.0)] + [("v", 1.0)], "user string, ts double")
    got = [(r.user, r.batch, r.first, r.last, r.n) for r in streams.debounced(e, "user").orderBy("user", "batch").collect()]
    assert got == [("u", 1, 0.0, 2.0, 6), ("u", 2, 2.4, 2.4, 1), ("u", 3, 5.0, 5.0, 1), ("v", 1, 1.0, 1.0, 1)]
    s = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("key"), F.col("timestamp").alias("ts"), F.lit(True).alias("ok"))
    assert streams.retries(s).schema.names == ["key", "due", "attempt"] and streams.debounced_stream(s, "key").isStreaming and streams.watch_files(spark, str(src)).isStreaming


def test_flush_and_compaction_shuffle_no_texts(spark, db, tmp_path):
    """Rows with one id in a buffer (the last added stays), docids dense, lengths and postings as counted anew; texts are in no exchange."""
    from skeinix.operators import bm25

    c = db.collection("n", Schema(1), analyzer("simple"))
    rows = [(f"d{i % 40}", f"fox w{i} w{i % 7} (fox)") for i in range(50)]
    c.add(spark.createDataFrame(rows, "id string, text string").repartition(3))
    c.add(spark.createDataFrame([("d1", "new hen"), ("x", None)], "id string, text string"))
    assert c.flush() == 41
    assert {r.id: r.text for r in c.live().collect()}["d1"] == "new hen" and sorted(r.docid for r in c.live().collect()) == list(range(41))
    c.delete(["d2", "x"])
    c.compact()
    live = c.live()
    assert sorted(r.docid for r in live.collect()) == list(range(39))
    tok = bm25.tokenised(live, key="docid")
    assert sorted(tuple(r) for r in c.postings().select("term", "docid", "tf", "dl").collect()) == sorted(tuple(r) for r in bm25.postings(tok).collect())
    assert {r.docid: r.dl for r in live.collect()} == {r.docid: len(r.tokens) for r in tok.collect()}
    rows = spark.createDataFrame([("a", "fox")], "id string, text string").withColumn("vector", F.array(F.lit(0.0).cast("float")))
    plans = []
    write, DataFrameWriter = None, type(rows.write)
    write = DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    DataFrameWriter.parquet = seen
    try:
        c.add(rows)
        c.flush()
    finally:
        DataFrameWriter.parquet = write
    assert plans and not any("Exchange hash" in p or "Exchange range" in p for p in plans[:3])
