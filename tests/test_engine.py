"""The retrieval engine: operators against worked values and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinix.functions import analyze, chunk, glob
from skeinix.functions import strings as S
from skeinix.functions.stem import stem
from skeinix.functions.vector import sq8_decode, sq8_encode
from skeinix.model import EngineError, Schema, SearchQuery
from skeinix.operators import ann, bm25, evaluate, filters, fusion, ingest, knn, search
from skeinix.sources import embed

V = "id long, vector array<float>"


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


# -- schema, query, errors ----------------------------------------------------
def test_schema_and_query():
    with pytest.raises(EngineError) as e:
        Schema(4097)
    assert e.value.code == -2
    for bad in ({"scalars": (("a", "int"), ("a", "int"))}, {"metric": "x"}, {"scalars": (("a", "date"),)}):
        with pytest.raises(EngineError):
            Schema(4, **bad)
    assert Schema.from_dict(Schema(4, "l2", (("a", "int"),)).to_dict()) == Schema(4, "l2", (("a", "int"),))
    q = SearchQuery.from_dict({"text": "x", "vector": [1, 2], "fusion": {"linear": {}}})
    assert (q.top_k, q.resolved_mode(), q.fusion, q.alpha, q.multiplier) == (10, "hybrid", "linear", 0.5, 3)
    for d in ({}, {"text": "x", "topK": 1001}, {"text": "x", "mode": "y"}):
        with pytest.raises(EngineError):
            SearchQuery.from_dict(d).resolved_mode()


# -- vectors ------------------------------------------------------------------
@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_knn_against_brute(spark, metric):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, [0.0] * 5)]
    df = spark.createDataFrame(data, V).repartition(3)
    q = [0.3, -0.2, 0.5, 0.1, 0.9]

    def score(v):
        d = sum(a * b for a, b in zip(v, q))
        n = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(a * a for a in q))
        return d if metric == "dot" else -math.dist(v, q) if metric == "l2" else d / n if n else 0.0

    want = sorted(((round(score([float(__import__("numpy").float32(x)) for x in v]), 6), -i) for i, v in data), reverse=True)[:10]
    got = [(round(s, 6), -i) for i, s in rows(knn.knn(df, q, 10, metric))]
    assert got == want
    batch = knn.knn_batch(df, spark.createDataFrame([(7, q)], V), 10, metric)
    assert [(round(r.score, 6), -r.id) for r in batch.orderBy("rank").collect()] == want
    monkey, knn.SEND = knn.SEND, 0
    try:
        again = knn.knn_batch(df, spark.createDataFrame([(7, q)], V), 10, metric)
        assert [(round(r.score, 6), -r.id) for r in again.orderBy("rank").collect()] == want
    finally:
        knn.SEND = monkey
    assert knn.knn(df, q, 0, metric).count() == 0


def test_sq8(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [0.5, 5.0])], V)
    t = knn.sq8_table(df).withColumn("back", sq8_decode(F.col("codes"), F.col("low"), F.col("high")))
    assert [(r.codes, r.back) for r in t.orderBy("id").collect()] == [([0, 0], [0.0, 5.0]), ([255, 0], [1.0, 5.0]), ([128, 0], [128 / 255, 5.0])]
    clamped = t.select(sq8_encode(F.array(F.lit(9.0), F.lit(1.0)), F.col("low"), F.col("high")).alias("c")).first().c
    assert clamped == [255, 0]
    assert [i for i, _ in rows(knn.knn_sq8(df, [1.0, 5.0], 1, "l2"))] == [2]


@pytest.mark.parametrize("share", [0.001, 0.01, 0.1, 0.5, 0.99])
def test_ann_recall_by_selectivity(spark, share):
    """Recall at 10 against the exact scan for filters of several selectivities."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) + 3 * (i % 7 == d) for d in range(12)], i) for i in range(1500)], V + ", place long").persist()
    index = ann.Inverted.train(df)
    table = index.assigned(df).persist()
    keep = F.col("place") < int(1500 * share) + 1
    hit = n = 0
    for k in range(3):
        q = [rng.gauss(0, 1) + 3 * (k == d) for d in range(12)]
        exact = {i for i, _ in rows(knn.knn(df.where(keep), q, 10))}
        got = {i for i, _ in rows(ann.ann(table, index, q, 10, share=0.7, allowed=keep))}
        hit, n = hit + len(exact & got), n + len(exact)
    assert hit / n >= 0.95


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_ann_finds_nine_of_ten(spark, sf, metric):
    """Every query whose id is divisible by 50, on vectors without clusters, where half of the lists don't do."""
    from skeinix.plans import queries

    v = queries._vectors(spark, sf).persist()
    index = ann.Inverted.train(v, metric=metric)
    table = index.assigned(v).persist()
    assert table.count() == v.count()
    some = F.col("label") >= 5
    for r in v.where("id % 50 = 0").collect():
        q = [float(x) for x in r.vector]
        exact = {i for i, _ in rows(knn.knn(v, q, 50, metric))}
        assert len(exact & {i for i, _ in rows(ann.ann(table, index, q, 50))}) >= 45
    exact = {i for i, _ in rows(knn.knn(v.where(some), q, 50, metric))}
    assert len(exact & {i for i, _ in rows(ann.ann(table, index, q, 50, allowed=some))}) >= 45
    if metric == "cosine":
        exact = {i for i, _ in rows(knn.knn(v, queries._query_vector(v), 50))}
        assert len(exact & {r.id for r in queries.ann_ivf(spark, sf).collect()}) >= 45


def test_ann_measures_where_it_can():
    rng = np.random.default_rng(5)
    spread = rng.standard_normal((900, 12))
    groups = np.repeat(np.eye(12) * 50, 75, axis=0) + rng.standard_normal((900, 12))
    few, many = (ann.Inverted(x[::30].copy(), "l2", x, len(x)) for x in (groups, spread))
    assert few.lists(groups[0], 10) < 8 < many.lists(spread[0], 10) <= 30
    assert many.lists(spread[0], 10) <= many.lists(spread[0], 10, 100)  # a filter: the nearest that pass lie farther off
    for index, q in ((ann.Inverted(spread[:30], "l2"), spread[0]), (many, [1.0]), (ann.Inverted(spread[:30], "l2", spread[:1], 1), spread[0])):
        assert index.lists(q, 10) == 30
    assert many.lists(spread[0], 0) >= 1 and many.lists(spread[0], 10**6) == 30


# -- filters ------------------------------------------------------------------
def test_filters(spark):
    kinds = {"lang": "keyword", "year": "int", "score": "float", "active": "bool"}
    df = spark.createDataFrame([(1, "zh", 2024, 9.5, True), (2, "en", 2023, 8.0, False), (3, None, None, float("nan"), None)], "id long, lang string, year long, score double, active boolean")
    ask = lambda spec: [r.id for r in df.where(filters.predicate(spec, kinds)).orderBy("id").collect()]
    assert ask({"lang": "zh"}) == [1] and ask({"year": {"in": [2023, 2024]}}) == [1, 2] and ask({"year": {"in": []}}) == []
    assert ask({"year": {"gte": 2024}}) == [1] and ask({"score": {"lte": 8.0}}) == [2] and ask({"active": {"gte": False}}) == [1, 2]
    assert ask({"lang": "zh", "year": 2023}) == [] and ask({"year": {"gte": 2023, "lte": 2023}}) == [2]
    assert ask({"year": 2024.0}) == [] == ask({"score": 8}) == ask({"lang": 5}) and ask({"score": float("nan")}) == []
    assert filters.predicate({}, kinds) is None
    for bad in ("nope", "vector"):
        with pytest.raises(EngineError):
            filters.predicate({bad: 1}, kinds)


# -- text ---------------------------------------------------------------------
def test_analyzers(spark):
    assert [stem(w) for w in "running runners caresses ponies ties cries relational hopping hoping happy sky generously".split()] == ["run", "runner", "caress", "poni", "tie", "cri", "relat", "hop", "hope", "happi", "sky", "generous"]
    assert analyze.standard_tokens("Running RUNNERS 2026") == ["run", "runner", "2026"] and analyze.standard_tokens("foo-bar 3.14 can't") == ["foo", "bar", "3.14", "can't"]
    assert analyze.bigram_tokens("机器学习") == ["机器", "器学", "学习"] and analyze.bigram_tokens("hello 世界 ok") == ["hello", "世界", "ok"] and analyze.bigram_tokens("中a文") == ["中", "a", "文"] and analyze.bigram_tokens("") == []
    words = {"测试": 100, "我": 100, "爱": 100, "北京": 200, "天安门": 300, "机器学习": 100, "学习": 200, "机器": 50, "研究": 100, "研究生": 50, "生命": 200, "命": 10, "的": 100}
    emit = {"S": {c: -3.0 for w in words for c in w}}
    a = analyze.analyzer("dictionary", words, emit=emit)
    assert a.tokens("我爱北京天安门") == ["我", "爱", "北京", "天安门"] and a.tokens("研究生命的") == ["研究", "生命", "的"]
    b = analyze.analyzer("dictionary", words, {"北京天安门": 10**6}, emit)
    assert b.tokens("我爱北京天安门 Runs") == ["我", "爱", "北京天安门", "run"] and a.id != b.id
    with pytest.raises(EngineError):
        analyze.analyzer("dictionary")
    assert analyze.analyzer("dictionary", degrade=True).name == "cjk_bigram"
    df = spark.createDataFrame([(1, "Running 机器学习"), (2, None), (3, "")], "id long, text string")
    for name in ("standard", "cjk_bigram", "simple"):
        a = analyze.analyzer(name)
        assert [r.t for r in df.select("id", a.column(F.col("text")).alias("t")).orderBy("id").collect()] == [a.tokens("Running 机器学习"), [], []]


def test_bm25(spark):
    df = spark.createDataFrame([(0, "a a a b"), (1, "a c c"), (2, None), (3, "")], "id long, text string")
    tok = bm25.tokenised(df)
    st = bm25.stats(tok).first()
    assert (st.n, st.avgdl) == (4, 7 / 4)
    post = bm25.postings(tok)
    assert rows(bm25.doc_freq(post), "term") == [("a", 2), ("b", 1), ("c", 1)]

    def score(tf, dl, d):
        return math.log((4 - d + 0.5) / (d + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.75))

    got = dict(rows(bm25.bm25(post, bm25.stats(tok), ["a", "c", "c", "zz"], 10)))
    assert got == pytest.approx({0: score(3, 4, 2), 1: score(1, 3, 2) + score(2, 3, 1)})
    assert dict(rows(bm25.bm25(post, bm25.stats(tok), ["a"], 10, df.where("id = 1").select(F.col("id").alias("docid"))))) == pytest.approx({1: score(1, 3, 2)})
    assert bm25.bm25(post, bm25.stats(tok), [], 10).count() == 0
    q = spark.createDataFrame([(9, ["a", "c"]), (8, ["zz"])], "qid long, tokens array<string>")
    assert [(r.qid, r.rank, r.id) for r in bm25.bm25_batch(post, bm25.stats(tok), q, 5).orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 0)]


# -- fusion -------------------------------------------------------------------
def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 1)], "id long, rank int")
    assert rows(knn.top(fusion.rrf(lists), 9)) == [(0, pytest.approx(1 / 60 + 1 / 61)), (1, pytest.approx(1 / 60 + 1 / 61))]
    s = "id long, score double"
    v, t = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 1.0)], s), spark.createDataFrame([(3, 7.0), (4, 7.0)], s)
    assert rows(fusion.fuse(v, t, 9, "linear", 0.5)) == [(1, 0.5), (2, 0.25), (3, 0.0), (4, 0.0)]
    assert rows(fusion.normalised(spark.createDataFrame([(1, float("nan"))], s)).select("id", "norm")) == [(1, 0.0)]
    p = spark.createDataFrame([("p", 0, "a", 0, False), ("p", 0, "b", 1, False), ("q", 1, "b", 0, True), ("q", 1, "c", 1, True)], "project string, list int, id string, rank int, degraded boolean")
    got = rows(fusion.rrf_projects(p, 9))
    assert [r[0] for r in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61) and got[0][2] is True and got[0][3] == "p"


# -- evaluation ---------------------------------------------------------------
def test_evaluation(spark):
    f = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "qid long, rank int, id long")
    rel = spark.createDataFrame([(1, 11, 3), (1, 99, 1)], "qid long, id long, rel int")
    assert dict(rows(evaluate.recall(f, rel.select("qid", "id")))) == {1: 0.5}
    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    assert dict(rows(evaluate.ndcg(f, rel))) == pytest.approx({1: (3 / math.log2(3)) / ideal, 2: 0.0})
    assert dict(rows(evaluate.overlap(f.select("qid", "id"), rel.select("qid", "id")))) == pytest.approx({1: 1 / 3, 2: 0.0})
    q = spark.createDataFrame([(1, "a b", ["a", "b"])], "qid long, text string, tokens array<string>")
    tok = spark.createDataFrame([(5, ["a", "a"]), (6, ["b"]), (7, ["z"])], "docid long, tokens array<string>")
    titles = spark.createDataFrame([(7, "a b")], "docid long, title string")
    assert rows(evaluate.grades(q, tok, titles), "id") == [(1, 5, 2), (1, 6, 1), (1, 7, 3)]


# -- globs, classification, names ---------------------------------------------
GLOBS = [("**/*.md", "docs/a.md", 1), ("**/node_modules/**", "app/node_modules/x/y.js", 1), ("**/*.{md,txt}", "a.txt", 1), ("**/*.md", "a.rs", 0), ("**/.git/**", "docs/git-notes.md", 0), ("**/*.md", "a.md", 1), ("**/.env.*", ".env.local", 1), ("docs/?.md", "docs/ab.md", 0), ("*.md", "docs/a.md", 0), ("docs/*", "docs/a.md", 1), ("docs/*", "docs/sub/a.md", 0), ("a/**", "a", 1), ("a/**/b", "a/b", 1), ("{a,b{c,d}}/x", "bd/x", 1), ("./a//b", "a/b", 1), ("a{b", "a{b", 1)]


def test_globs_and_classify(spark):
    for p, path, want in GLOBS:
        assert glob.glob_match(p, path) == bool(want), (p, path)
        df = spark.createDataFrame([(path,)], "path string")
        assert df.select(glob.glob(F.col("path"), p)).first()[0] == bool(want)
    pol = glob.Policy(exclude=("**/skip/**",), types=(glob.TypeRule("**/*.md"), glob.TypeRule("**/*.pdf", "pdf"), glob.TypeRule("**/*.png", "image", False), glob.TypeRule("**/*.png", "image")))
    df = spark.createDataFrame([("a.md",), ("skip/a.md",), ("b.pdf",), ("c.png",), ("d.xyz",)], "path string")
    c = glob.classify(F.col("path"), pol)
    assert [(r.x.extractor, r.x.skip) for r in df.select(c.alias("x")).collect()] == [("text", None), (None, "excluded"), (None, "disabled"), ("image", None), (None, "no_type")]
    assert [r[0] for r in df.select(glob.unsupported(F.col("path"), pol)).collect()] == [None, None, "pdf", None, None]
    assert not glob.watched_dir("x/skip", pol) and glob.watched_dir("x", pol)
    assert pol.over(exclude=("z",), include=("*.x",), max_chars=7).types == (glob.TypeRule("*.x"),) and pol.over(exclude=("z",)).exclude == ("**/skip/**", "z")
    assert glob.provenance({"global": {"a": 1, "b": 2, "api_key": "s"}, "file": {"b": 3}}) == {"a": "global", "b": "file"}


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first().x


def test_string_functions(spark):
    c = F.col
    assert tuple(one(spark, S.parse_doc_id(c("v")), v="p:a:b#c#3")) == ("p", "a:b#c", 3) and one(spark, S.parse_doc_id(c("v")), v="nope") is None
    assert tuple(one(spark, S.parse_embed_model_id(c("v")), v="oai:m:x:384")) == ("oai", "m:x", 384)
    assert one(spark, S.redact(c("v")), v="k sk-proj-abc_1 sk-zz, api_key = \"hush\", my_api_key=keep api_key: x") == 'k sk-proj-*** sk-***, api_key = "***", my_api_key=keep api_key: ***'
    assert [one(spark, S.embeddings_url(c("v")), v=u) for u in ("http://a/", "http://a/v1", "http://a/embeddings")] == ["http://a/v1/embeddings", "http://a/v1/embeddings", "http://a/embeddings"]
    assert [one(spark, S.probe_error_code(c("v")), v=m) for m in ("HTTP 401", "dim mismatch", "Connection refused", "?")] == ["embed_auth", "embed_dim", "embed_unreachable", "embed_probe"]
    assert [one(spark, S.relative_time(c("t"), F.lit(10_000_000)), t=10_000_000 - d) for d in (-5, 9, 59, 3599, 172_799, 2_591_999, 2_592_000)] == ["just now", "just now", "59 seconds ago", "59 minutes ago", "47 hours ago", "29 days ago", "1970-03-27"]
    assert one(spark, S.relative_time(c("t"), F.lit(5)), t=0) == "never"
    assert [one(spark, S.mime(c("v")), v=p) for p in ("a.PNG", "b/c.jpeg", "x")] == ["image/png", "image/jpeg", "application/octet-stream"]
    assert one(spark, S.snippet(c("v"), F.lit("H")), v="A > B\nbody") == "body" and one(spark, S.snippet(c("v"), F.lit("H")), v="H\nbody") == "body" and one(spark, S.snippet(c("v"), F.lit("H")), v="x\nbody") == "x\nbody"
    assert [one(spark, S.skip_kind(c("v"), F.lit(True)), v=m) for m in ("bad UTF-8", "file too large", "other")] == ["invalid_utf8", "too_large", "extractor_unsupported"]
    assert one(spark, S.is_path_prefix(F.lit("/a"), c("v")), v="/ab") is False and one(spark, S.is_path_prefix(F.lit("/a"), c("v")), v="/a/b") is True
    paths = spark.createDataFrame([("/a/b/c",), ("/ab/x",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "root string")
    assert rows(S.longest_root(paths, roots), "path") == [("/a/b/c", "/a/b"), ("/ab/x", "/ab"), ("/z", None)]
    assert rows(S.nested(roots)) == [("/a/b", "/a")]
    assert S.chunk_strategy_id() != S.chunk_strategy_id(max_chars=5) and len(S.chunk_strategy_id()) == 16
    assert search.scope("/a/b/c", {"/a/b"}, ["/a"]) == ["/a/b"] and search.scope("/a/x", set(), ["/a", "/z"]) == ["/a"] and search.scope("/q", set(), ["/a"]) == ["/a"]
    assert search.explain_empty({"excluded": True, "embedder": True}) == "embedder" and search.explain_empty({}) == "no_match"
    assert [search.clamp(k) for k in (0, 9, 99)] == [8, 9, 50]


# -- chunks -------------------------------------------------------------------
def test_chunks(spark):
    got = chunk.chunk_text("# API\n\nintro text here\n\n## 鉴权\n\nsecret token flow\n", chunk.ChunkConfig(min_chars=1))
    assert [g[1] for g in got] == [["API"], ["API", "鉴权"]] and got[1][0].startswith("API > 鉴权\n") and got[1][2:] == (24, 53, 1)
    assert chunk.headings("Title\n===\n\n### c ##\nx\n---\n    # no\n#no\n") == [(0, 1, "Title"), (11, 3, "c"), (20, 2, "x")]
    cfg = chunk.ChunkConfig("plain", 10, 3, 0)
    text = "aaaa\n\nbbbb\ncccccccccccccccccccccccc\n"
    parts = chunk.chunk_text(text, cfg)
    raw = text.encode()
    assert b"".join(raw[p[2] : p[3]] for p in parts) == raw and all(p[3] - p[2] <= 10 for p in parts)
    for a, b in zip(parts, parts[1:]):
        assert b[0] == a[0][-3:] + text[b[2] : b[3]]
    assert chunk.chunk_text("", cfg) == [] and chunk.chunk_text("ab", chunk.ChunkConfig("plain", 10, 0, 5))[0][0] == "ab"
    for bad in ({"max_chars": 0}, {"overlap_chars": 2000}, {"min_chars": 5000}, {"split": "x"}):
        with pytest.raises(EngineError):
            chunk.ChunkConfig(**bad)
    df = spark.createDataFrame([(1, "# A\n\n" + "word " * 400, False), (2, None, None), (3, "# x\ny", True)], "id long, text string, html boolean")
    out = chunk.chunks(df, plain="html").collect()
    assert {r.id for r in out} == {1, 3} and [r.headings for r in out if r.id == 3] == [[]] and len([r for r in out if r.id == 1]) == 2
    spark.udtf.register("chunks_of", chunk.chunker())
    assert spark.sql("select chunk_index, text from chunks_of('# T\n\nhello')").first().text == "T\n# T\n\nhello"


# -- embeddings and caches ----------------------------------------------------
def test_embedders(spark):
    v = embed.hash_vector("Hello hello world", 16)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and embed.hash_vector("", 4) == [0.0] * 4
    df = spark.createDataFrame([(1, "Hello hello world"), (2, None)], "id long, text string")
    assert embed.embedded(df, embed.hashing(16)).orderBy("id").first().vector == pytest.approx(v)
    sparse = {r.d: r.x for r in embed.hash_embedding(df, dim=16).collect()}
    assert sparse == pytest.approx({i: x for i, x in enumerate(v) if x})
    assert embed.ordered([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    for bad in ([{"index": 0, "embedding": [1.0]}], [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": []}]):
        with pytest.raises(EngineError):
            embed.ordered(bad, 2)


def test_reconcile_tables(spark):
    disk = spark.createDataFrame([("a", "1", "k1"), ("b", "2", "k2"), ("c", "3", "k3")], "path string, content_sha256 string, extract_key string")
    live = spark.createDataFrame([("a", "1", "k1", 2), ("b", "0", "k0", 3), ("d", "9", "k9", 1)], "path string, content_sha256 string, extract_key string, chunk_count long")
    acts = ingest.actions(disk, live)
    assert rows(acts.select("path", "action"), "path") == [("a", "unchanged"), ("b", "updated"), ("c", "added"), ("d", "removed")]
    assert sorted(r.id for r in ingest.stale_ids(acts, "p").collect()) == ["p:b#0", "p:b#1", "p:b#2", "p:d#0"]
    assert tuple(ingest.report(acts).first()) == (1, 1, 1, 1)
    assert rows(ingest.diff(live, disk), "path") == [("b", "updated"), ("c", "added"), ("d", "removed")]
    cache = spark.createDataFrame([("x", 100), ("y", 900), ("z", None), ("w", 100)], "key string, last_seen long")
    keep = spark.createDataFrame([("w",)], "key string")
    assert sorted(r.key for r in ingest.garbage(cache, keep, "key").collect()) == ["x", "y", "z"]
    assert [r.key for r in ingest.garbage(cache, keep, "key", 1000, 500).collect()] == ["x"]
    assert sorted(r.key for r in ingest.garbage(cache, keep, "key", 1000, 500, spark.createDataFrame([("z",)], "key string")).collect()) == ["x", "z"]
    assert ingest.needs_compaction(1000, 5, 0) and ingest.needs_compaction(0, 10, 2) and not ingest.needs_compaction(999, 100, 19)
    q = ingest.DirtyQueue.empty(spark).push(spark.createDataFrame([("p", "f")], "project string, path string"))
    seen, due_at = [], [0, 1, 2, 3, 4, 5, 6, 7]
    for now in due_at:
        due, q = q.pop(now)
        seen += [now] * due.count()
        q = ingest.DirtyQueue(q.table.checkpoint() if False else spark.createDataFrame(q.table.collect(), q.table.schema))
    assert seen == [1, 3, 7]
    assert [one(spark, ingest.backoff(F.col("n")), n=n) for n in (1, 2, 3, 7, 8)] == [1, 3, 7, 123, 183]


def test_postings_against_brute_force(spark):
    from collections import Counter

    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"] * 50 + ["é", ""]), (5, ["a"]), (None, ["z"])]
    tok = spark.createDataFrame(rows, "docid long, tokens array<string>").withColumn("tf", F.lit("clash"))
    want = sorted(((t, d, n, len(w)) for d, w in rows for t, n in Counter(w or ()).items()), key=repr)
    assert sorted((tuple(r) for r in bm25.postings(tok.repartition(3)).collect()), key=repr) == want
    assert sorted((tuple(r) for r in bm25.postings(tok, ["a", "z", "a", "none"]).collect()), key=repr) == [x for x in want if x[0] in ("a", "z")]
    assert bm25.postings(tok.limit(0)).count() == 0 == bm25.postings(tok, []).count()


def test_sparse_hash_embeddings_are_the_embedder(spark):
    from skeinix.sources.embed import hash_embedding, hashing

    texts = ["Red fox runs", "", None, "x", "Ünïcode 12-34 a a a", "the the the"]
    got = {}
    for r in hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), dim=16).collect():
        got.setdefault(r.id, {})[r.d] = r.x
    for i, v in enumerate(hashing(16)([t or "" for t in texts])):
        assert {d: round(x, 5) for d, x in got.get(i, {}).items()} == {d: round(float(x), 5) for d, x in enumerate(v) if x}


# -- tables of queries over texts ---------------------------------------------
def test_texts_that_hold_queries(spark):
    """Short, empty, overlapping and non-ASCII queries, at word borders and within words, against brute force."""
    import pyarrow as pa

    from skeinix.operators import contain

    rng = random.Random(3)
    docs = [None, "", "a", "zażółć gęślą", "one two three four five six", "x" * 200, "aé" * 90] + ["".join(rng.choices("ab é\n", k=rng.randrange(300))) for _ in range(60)]
    qs = [None, "", "a", "é", "two thr", "wo three four fiv", "three four five six seven", "x" * 64, "x" * 65, "x" * 201, "éa" * 40, "a", "żół"] + ["".join(rng.choices("ab é\n", k=n)) for n in range(1, 9)] + [docs[20][5:140], docs[30][1:70]]
    want = sorted((q, d) for q, t in enumerate(qs) for d, x in enumerate(docs) if t is not None and x is not None and t in x)
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(qs)), "qid long, q string")
    assert sorted(tuple(r) for r in contain.holding(d, q).collect()) == want
    old, contain.SENT, contain.STEP = (contain.SENT, contain.STEP), 40, 100
    try:
        assert sorted(tuple(r) for r in contain.holding(d, q).collect()) == want
        find = contain.Finder([b"aba", b"b" * 30])
        assert find(pa.array(["z", "ab" * 60 + "b" * 29, "b" * 130, None]).slice(1)) == [(0, 0), (0, 1), (1, 1)]
    finally:
        contain.SENT, contain.STEP = old


def test_batches_over_texts_are_those_over_postings(spark):
    """Ties, short lists, repeated query rows, blocks of queries, shared ids, null and odd texts."""
    from skeinix.functions.analyze import simple

    rng = random.Random(4)
    words = ["a", "b", "Fox", "fox.", "(été)", "İx", "x-y", "don't", "12", "²", "ß", "ΑΣ"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(300)] + [(900, None), (901, ""), (902, " \n"), (903, "a" * 70)]
    docs = spark.createDataFrame(rows, "docid long, text string").repartition(5)
    qs = [(1, "a fox"), (2, "été 12 y"), (3, None), (4, "none"), (5, "b"), (5, "a ix ας"), (6, "a" * 70)]
    q = spark.createDataFrame(qs, "qid long, text string").select("qid", "text", simple(F.col("text")).alias("tokens"))
    once = spark.createDataFrame([(i, " ".join(t or "" for j, t in qs if i == j)) for i in range(1, 7)], "qid long, text string").select("qid", "text", simple(F.col("text")).alias("tokens"))
    old = bm25.PAIRS, bm25.CELLS
    for d in (docs, docs.unionByName(docs.limit(9))):
        tok = bm25.tokenised(d, key="docid")
        want = sorted(tuple(r) for r in bm25.bm25_batch(bm25.postings(tok), bm25.stats(tok), once, 7, 9).collect())
        grade = sorted(tuple(r) for r in evaluate.grades(once, tok, k=7).collect())
        for bm25.PAIRS, bm25.CELLS in (old, (2, 8)):
            try:
                assert sorted(tuple(r) for r in bm25.bm25_batch_texts(d, q if d is docs else once, 7, 9).collect()) == want
                assert sorted(tuple(r) for r in evaluate.grades_of_texts(q if d is docs else once, d, 7).collect()) == grade
            finally:
                bm25.PAIRS, bm25.CELLS = old
    assert bm25.bm25_batch_texts(docs.limit(0), q, 5).count() == 0 == bm25.bm25_batch_texts(docs, q.limit(0), 5).count()


def test_term_counts_in_tasks(spark):
    """Counted by pieces, also where the tables of a task are emptied, as text by text."""
    from collections import Counter

    from skeinix.functions import analyze as A

    rng = random.Random(6)
    pieces = ["running", "Runs,", "(runs)", "don't", "3.5", "e.g.", "été", "İx", "²", "x²", "机器学习", "_a_", "a'", "ΑΣ", "foxes run", "　中", "--", "U.S.A.", "a1", "é1"]
    texts = [None, "", " \n "] + ["".join(rng.choice(pieces) + rng.choice(" \n\t ") for _ in range(rng.randrange(30))) for _ in range(80)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    old = A.PIECES
    for name in ("standard", "simple", "cjk_bigram"):
        a = A.analyzer(name)
        if name == "simple":
            each = [r.t for r in d.select(a.column(F.col("text")).alias("t")).collect()]
        else:
            each = [a.tokens(t) for t in texts]
        want = {t: (sum(t in x for x in each), sum(x.count(t) for x in each)) for t in {y for x in each for y in x}}
        for A.PIECES in (old, 3):
            try:
                assert {r.term: (r.df, r.cf) for r in A.term_counts(d, a.tokens).collect()} == want
            finally:
                A.PIECES = old
        assert sorted(r.n for r in d.select(A.lengths(a.tokens)(F.col("text")).alias("n")).collect()) == sorted(map(len, each))
    assert Counter(A.standard_tokens("Foxes, foxes.")) == {"fox": 2}
