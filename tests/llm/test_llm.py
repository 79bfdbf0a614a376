"""Operators against brute force, exact round trips and defined edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("skeinix.llm")

from pyspark.sql import Row  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skeinix.llm import ann, bpe_codec, components, edit_counts, licenses, line_dedup, ngram_join, packing, quality, url_filter, warc  # noqa: E402
from skeinix.llm.bpe import TrieBPE, load, tokenizer_path  # noqa: E402
from skeinix.llm.common import settled, table  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "\n\n", "one", "a b c d", "x" * 5000, "word " * 3000, "日本語 テスト\nπ ρ ΣΑΣ", "<|endoftext|> hi <|startoftext|>", "tab\tand\x0bvt\x1cfs nbsp", "don't WE'LL 'sorry' 3½ été"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs(spark, texts, ids=None, **kw):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, kw.get("lang"), None, None if t is None else len(t)) for i, t in zip(ids, texts)], DOC)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def near_copies(seed=1, families=6, noise=10):
    rng, out = random.Random(seed), []
    passage = sentence(rng, 60)
    for _ in range(families):
        base = sentence(rng, 120).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            out.append(" ".join(w))
    out += [sentence(rng, 80) + " " + passage for _ in range(noise)]
    out += [sentence(rng, n) for n in (4, 5, 6, 7, 8, 10)] + TEXTS + [out[0], out[0].upper()]
    rng.shuffle(out)
    return out


# -- components ---------------------------------------------------------------
def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7), (None, 3)]
    uf = components.UnionFind()
    for a, b in edges:
        if a is not None and a != b:
            uf.union(a, b)
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: uf.find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 3 ------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_trie_matches_library(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    lib, own = Tokenizer.from_file(path), TrieBPE(path, memo_words=500)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab c\n.,'sé  \t😀Σ1-") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["-" * 300 + " " * 300, "aaaa" * 700]
    for t, ids in zip(texts, own.encode_batch(texts)):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want, t
        if not own.end:
            assert own.decode(want) == lib.decode(want, skip_special_tokens=False) == (t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_flat_encoding_matches_library(name, monkeypatch):
    from tokenizers import Tokenizer

    from skeinix.llm import bpe

    path = tokenizer_path(name)
    lib, own = Tokenizer.from_file(path), TrieBPE(path, memo_words=1000)
    rng = random.Random(8)
    chars = "ab1'strevmld'' \n\t.,\"é½²٣日本ΣİßK\u0301\u0338<|\x1c\x85\u3000😀𝟘𐐀"
    texts = TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["'", "a'", "'s", "'S'tis 'll'LL we'veve ''s .'s '\n's 'é 'r 'l", "\u0301a", "e", "\u0301"]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for step in (1, 7, len(texts)):
        for at in range(0, len(texts), step):
            flat, ends = own.encode_flat(texts[at : at + step])
            assert [x.tolist() for x in np.split(flat, ends)] == want[at : at + step] + [[]]
            assert step > 7 or len(own.raw_words) <= 1000
    assert [x.tolist() for x in own.encode_flat([])] == [[], []] and [x.tolist() for x in own.encode_flat([None, ""])] == [[], [0, 0]]
    monkeypatch.setattr(bpe, "PIECE", 20)
    flat, ends = own.encode_flat(texts)
    assert [x.tolist() for x in np.split(flat, ends)] == [x.tolist() for x in own.encode_batch(texts)] + [[]]


def test_kinds_are_those_of_the_patterns():
    from skeinix.llm import bpe

    own, kinds = TrieBPE(tokenizer_path("word_bpe_49k.json")), bpe._kinds()
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        for shape in (own._any, own._latin)[: 1 + (c < "\u0250")]:
            assert bool(shape.match(c)) == (kinds[ord(c)] != bpe._SPACE)
            if kinds[ord(c)] != bpe._SPACE:
                assert (len(shape.match(c * 2)[0]) == 1) == (kinds[ord(c)] == bpe._DIGIT)
                assert (len(shape.match(c + "a")[0]) == 2) == (kinds[ord(c)] == bpe._LETTER)


def test_codec_round_trip_and_digests(spark):
    from tokenizers import Tokenizer

    d = docs(spark, TEXTS).withColumn("ids", F.lit("clash"))
    both = bpe_codec.decode(bpe_codec.encode(d))
    assert {r.doc_id: r.decoded for r in both.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in bpe_codec.round_trip(d).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.round_trip(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        bpe_codec.encode(d.withColumn("token_ids", F.lit(1)))


# -- 7 ------------------------------------------------------------------------
def brute_cuts(at, pen, size):
    best = {0: (0, [])}
    for j, s in enumerate(at):
        opts = [(best[p][0] + size - (s - p) + pen[j], best[p][1] + [s]) for p in [0, *at[:j]] if s - p <= size]
        best[s] = min(opts, key=lambda x: x[0])
    return best[at[-1]][0]


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        gaps = [rng.randint(1, 6) for _ in range(rng.randint(1, 25))]
        at = np.cumsum(gaps)
        pen = np.array([rng.choice([0, 2, 24]) for _ in gaps])
        found = packing.cuts(at, pen, 10)
        cost = sum(10 - (b - a) + pen[list(at).index(b)] for a, b in zip([0, *found], found))
        assert found[-1] == at[-1] and all(b - a <= 10 for a, b in zip([0, *found], found))
        assert cost == brute_cuts(at.tolist(), pen.tolist(), 10)


@pytest.mark.parametrize("stretch", [1 << 18, 900])
def test_packing_is_a_partition(spark, stretch):
    rng = random.Random(5)
    texts = TEXTS + [". ".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 40))) + "." for _ in range(40)]
    d = docs(spark, texts).repartition(3)
    size = 256
    p = packing.pack(d, size=size, stretch=stretch).collect()
    bpe = load(tokenizer_path("word_bpe_49k.json"))
    by = collections.defaultdict(list)
    for r in p:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.append(bpe.encode(t), 1)
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist() and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
    seq = collections.defaultdict(list)
    for r in p:
        seq[r.sequence_id].append(r)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    pad = packing.padding(spark.createDataFrame(p, packing.SCHEMA), size).first()
    assert pad.padding < 0.2 * pad.tokens
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(d, order=["doc_id"]).groupBy().sum("length").first()[0] == sum(len(bpe.encode(t)) + 1 for t in texts)


# -- 8 ------------------------------------------------------------------------
def test_edits_match_a_full_count(spark):
    bpe = load(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(6)
    bits = ["hello world", "  \n\n x", " ", "\n", "a,b,c!!", "don't", "<|endoftext|>", "<|end", "oftext|>", "über  mé", "   ", "12 34"]
    for _ in range(150):
        t = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 400])))
        c = edit_counts.CountedText(t, bpe)
        for _ in range(6):
            s, n, new = rng.randint(0, len(t) + 2), rng.choice([0, 1, 3, 10, 200]), rng.choice([*bits, "", " ".join(bits) * 9])
            c.edit(s, n, new)
            t = t[:s] + new + t[s + n :]
            assert c.text == t and c.n_tokens == len(bpe.encode(t))
    long = " ".join(rng.choice(WORDS) for _ in range(20_000))
    c = edit_counts.CountedText(long, bpe)
    c.edit(50_000, 3, "new words here")
    assert c.reencoded < 60
    out = edit_counts.count_edits(edit_counts.with_edits(docs(spark, TEXTS))).collect()
    assert len(out) == len(TEXTS)
    none = docs(spark, TEXTS).withColumn("edits", F.lit(None).cast(edit_counts.EDITS))
    assert all(r.n_tokens == r.n_tokens_after == len(bpe.encode(TEXTS[r.doc_id])) for r in edit_counts.count_edits(none).collect())


# -- 9 ------------------------------------------------------------------------
def brute_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    wins = collections.defaultdict(list)
    for i in range(len(w) - 4):
        wins[tuple(w[i : i + 5])].append(i)
    covered = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    seen, dup, lines = set(), 0, 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            lines += 1
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), lines


def test_quality_counts():
    rng = random.Random(7)
    for t in TEXTS + [" ".join(rng.choice("ab#*|") for _ in range(rng.randint(0, 60))) + rng.choice(["\n", ""]) * 3 for _ in range(200)]:
        assert quality.counts(t)[:6] == brute_counts(t)


def test_binomial_bound():
    for n in (1, 7, 40):
        for k in range(n):
            exact = sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1))
            assert abs(quality.binomial_tail(k, n, 0.1) - exact) < 1e-9
    assert quality.shown(0, 5000, 0.002, 1e-3) and not quality.shown(0, 100, 0.002, 1e-3) and not quality.shown(0, 0, 0.5, 0.5)


def test_quality_thresholds_limit_false_rejection(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(4000):
        bad = i % 10 == 0
        t = sentence(rng, 30)
        texts.append("#### " * 20 + t if bad else t + (" #" if rng.random() < 0.001 else ""))
        labels.append((i, 0 if bad else 1, 0))
    d = docs(spark, texts, lang="en")
    lab = spark.createDataFrame(labels + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    feats, chosen = quality.learned(d, lab, risk=0.05)
    out = {r.doc_id: r for r in quality.verdicts(feats, chosen).collect()}
    good = [i for i in range(4000) if i % 10]
    assert sum(not out[i].kept and not out[i].base_failed for i in good) <= 0.05 * len(good)
    assert all(not out[i].kept for i in range(0, 4000, 10))
    kept = quality.keep_good(d.withColumn("kept", F.lit(1)), quality.cutoffs(chosen))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept} and kept.columns == [*d.columns, "kept"]
    few = spark.createDataFrame(labels[:50], lab.schema)
    assert quality.fit(feats, few).count() == 0  # too few labels: nothing but the base rules rejects
    edge = quality.features(docs(spark, TEXTS))
    assert edge.where("doc_id = 0").first().base_failed and quality.fit(quality.features(docs(spark, [])), lab).count() == 0


def test_quality_learns_from_some_hundred_labels(spark):
    """Separable junk goes where a stratum has the labels that the joint bound needs."""
    rng = random.Random(18)
    rows = [(i, sentence(rng, 30).replace(" ", " " if i % 10 else " ##"), "de" if i < 700 else "es", None, 0) for i in range(900)]
    d, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    feats, chosen = quality.learned(d, lab)
    gone = {r.doc_id for r in quality.verdicts(feats, chosen).where("not kept").collect()}
    assert gone >= set(range(0, 700, 10)) and not any(i >= 700 for i in gone)  # 630 and 180 good labels
    assert sum(i % 10 > 0 for i in gone) <= 0.01 * 630
    assert quality.able([(630, 1), (180, 1)], 0.01, 0.05) == 1 and quality.able([(2076, 1), (507, 1), (505, 1), (321, 1)], 0.01, 0.05) == 3


def brute_fit(rows, risk, miss):
    """Cutoffs by definition: each set of the sequence is tested on the distinct good texts alone; rows: (stratum, text, label or None)."""
    strata = {}
    for s, t, y in rows:
        c = dict(zip(quality.COUNTS, quality.counts(t)))
        if c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]:
            continue
        chars, words = max(1, c["word_chars"]), max(1, c["n_words"])
        sc = [c["n_symbols"] / chars, c["n_dup_lines"] / max(1, c["n_lines"]), c["n_repeat_words"] / words, c["n_upper"] / chars, c["word_chars"] / words]
        at = tuple(sum(x > g for g in quality.GRID[r]) for x, r in zip(sc, quality.RULES))
        own = strata.setdefault(s, {})
        if y is None:
            own.setdefault((at, None), []).append(None)
        else:
            own[at, t] = max(y, own.get((at, t), 0))
    goods = {s: [k[0] for k, y in own.items() if y == 1] for s, own in strata.items()}
    m = 0
    for n in sorted(map(len, goods.values()), reverse=True):
        m += (1 - risk) ** n <= miss / (m + 1)
    out = {}
    for s, own in strata.items():
        cells = {}
        for (at, _), y in own.items():
            c = cells.setdefault(at, [0, 0])
            if y is None or isinstance(y, list):
                c[1] += len(y)
            elif y == 0:
                c[0] += 1
        keys = sorted(cells)
        n = len(goods[s])
        ok = lambda k: n and k <= risk * n and sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) <= miss / max(1, m)
        if not ok(0):
            continue
        for cut in quality.sequence(np.array(keys).reshape(-1, len(quality.RULES)), np.array([cells[k][0] for k in keys]), np.array([cells[k][1] for k in keys])):
            if not ok(sum(any(a > c for a, c in zip(at, cut)) for at in goods[s])):
                break
            out[s] = cut
    return {s: {r: c for r, c in zip(quality.RULES, cut) if c < len(quality.GRID[r])} for s, cut in out.items()}


def test_fit_against_brute_force(spark):
    rng = random.Random(28)
    rows = []
    for i in range(1500):
        s = ("en", "de", None)[i % 3]
        y = None if i % 11 == 0 else int(i % 10 > 0)
        t = sentence(rng, 14)
        if y == 0 or rng.random() < 0.004:
            t = t.replace(" ", rng.choice([" ##", " %", " "])).upper() if rng.random() < 0.5 else t + "\n" + "\n".join(["same line"] * rng.randint(1, 9))
        rows.append((s, t, y))
    rows += [r for r in rows if r[2] == 1][:40] * 30  # copies are no further trials
    d = spark.createDataFrame([(i, t, s, None, 0) for i, (s, t, _) in enumerate(rows)], DOC)
    lab = [(i, y, 0) for i, (_, _, y) in enumerate(rows) if y is not None]
    lab = spark.createDataFrame(lab + lab[:200], "doc_id long, quality int, toxic int")
    want = brute_fit([(s or "", t, y) for s, t, y in rows], 0.02, 0.05)
    got = collections.defaultdict(dict)
    for r in quality.learned(d, lab, risk=0.02)[1].collect():
        got[r.stratum][r.rule] = r.cut
    assert got == want and want
    feats, chosen = quality.learned(d, lab, risk=0.02)
    kept = sorted(r.doc_id for r in quality.verdicts(feats, chosen).where("kept").collect())
    clash = d.withColumn("__stratum", F.lit(1)).withColumn("__of", F.lit(1)).withColumn("stratum", F.lit(1))
    for most in (100, 0):  # with the function, and joined
        own = quality.keep_good(clash, chosen, most_strata=most)
        assert sorted(r.doc_id for r in own.collect()) == kept and own.columns == clash.columns


def test_strata_of_other_types(spark):
    rng = random.Random(29)
    rows = [(i, sentence(rng, 30).replace(" ", " " if i % 10 else " ##"), i % 2 == 0) for i in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang boolean")
    lab = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(1600)], "doc_id long, quality int, toxic int")
    _, chosen = quality.learned(d, lab)
    assert {r.stratum for r in chosen.collect()} == {"true", "false"}
    assert {r.doc_id for r in quality.keep_good(d, chosen).collect()} == {i for i in range(1600) if i % 10}


# -- 10 -----------------------------------------------------------------------
def brute_join(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(texts)
    adj = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(n)]
    uf = components.UnionFind()
    for i in range(n):
        for j in adj[i]:
            uf.union(i, j)
    return {i: (len(sets[i]), len(adj[i]), uf.find(i)) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join(spark, seed):
    texts = near_copies(seed)
    d = docs(spark, texts).withColumn("f1", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.ngram_join(d).collect()}
    assert got == brute_join(texts)


def test_keep_one_and_edges(spark):
    texts = near_copies(9)
    want = brute_join(texts)
    kept = ngram_join.keep_one(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, _, c) in want.items() if c == i}
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    null_ids = docs(spark, ["a b c d e f", "a b c d e f", "q r s t u v"], [None, 3, None])
    rows = ngram_join.ngram_join(null_ids).collect()
    assert sorted((r.doc_id or -1, r.n_similar, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 1, 3), (3, 1, 3)]
    shared = docs(spark, ["a b c d e f", "a b c d e f", "q r s t u v"], [1, 2, 2]).withColumn("__id", F.lit("x")).withColumn("__row", F.lit(1)).withColumn("__n", F.lit(2))
    left = ngram_join.keep_one(shared)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "a b c d e f"), (2, "q r s t u v")] and left.columns == shared.columns
    twice = docs(spark, ["a b c d e f"] * 2, [4, 4])
    assert [r.n_similar for r in ngram_join.ngram_join(twice).collect()] == [1, 1] and ngram_join.keep_one(twice).count() == 1
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def chained(seed=4, n=60):
    """Texts of which each shares a half with the one before, so that candidates form a chain, with some near copies."""
    rng, out, last = random.Random(seed), [], sentence(random.Random(1), 100).split()
    for i in range(n):
        new = last[50:] + sentence(rng, 50).split()
        out.append(" ".join(new))
        if i % 7 == 0:
            out.append(" ".join([*new[:60], "changed", *new[61:]]))
        last = new
    return out


@pytest.mark.parametrize("texts", [chained(), near_copies(5, families=3, noise=3)])
def test_ngram_join_of_large_components(spark, texts):
    """Components larger than a block are compared whole or by signatures; the result is the same."""
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts).repartition(3), block=4).collect()}
    assert got == brute_join(texts)


def test_chain_is_compared_by_signatures(spark):
    """A long chain of weak candidates isn't compared as one group: the pairs verified grow with the chain, not with its square."""
    texts = chained(6, 240)
    d = docs(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("row"))
    m, frequent = ngram_join.marks(d)
    edges = ngram_join.candidate_edges(d.repartition(4), frequent)
    groups = components.components(edges)
    most = groups.groupBy("component").count().agg(F.max("count")).first()[0]
    t = d.select(F.lit(0).cast("long").alias("group"), F.col("doc_id").alias("id"), "text")
    pairs = ngram_join.by_signature(t, frequent, 80, 100).groupBy("key").count().where("count > 1").selectExpr("sum(count * count)").first()[0] or 0
    assert most > 20 and pairs < 60 * len(texts)


def test_signatures_meet():
    """Sets at the threshold share a signature, whatever is frequent."""
    rng = np.random.default_rng(10)
    for _ in range(600):
        a = rng.integers(1, 2**63, rng.integers(4, 400)).astype(np.uint64)
        best = None
        for _ in range(20):
            drop, add = rng.integers(0, len(a) // 4 + 1), rng.integers(0, len(a) // 4 + 1)
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, add).astype(np.uint64)])
            common = len(a) - drop
            if len(b) and 100 * common >= 80 * (len(a) + len(b) - common) and drop + add:
                best = b
        if best is None:
            continue
        hot = lambda s: (s % np.uint64(3) == 0).astype(np.uint8)
        a, b = np.sort(a), np.sort(best)
        assert np.intersect1d(ngram_join.signatures(a, hot(a)), ngram_join.signatures(b, hot(b))).size


# -- 5 ------------------------------------------------------------------------
def brute_lines(texts):
    cls = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                cls[x].append((i, n))
    lines = list(cls)
    sets = [{x[i : i + 8].ljust(8, "\0") for i in range(max(1, len(x) - 7))} for x in lines]
    uf = components.UnionFind()
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                uf.union(i, j)
    comp = collections.defaultdict(list)
    for i, x in enumerate(lines):
        comp[uf.find(i)] += cls[x]
    return {x: (*min(m), len(m)) for m in comp.values() for x in m}


def test_line_dedup(spark):
    rng = random.Random(11)
    pool = [sentence(rng, n) for n in (1, 2, 8, 12, 20, 40)]
    texts = []
    for _ in range(40):
        x = [rng.choice(pool) if rng.random() < 0.4 else sentence(rng, 10) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            w = list(rng.choice(pool))
            w[len(w) // 2] = "~"
            x.append("".join(w))
        texts.append("\n".join(x))
    texts += TEXTS + [texts[0]]
    d = docs(spark, texts).withColumn("id", F.lit("clash")).repartition(3)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.n_lines) for r in line_dedup.line_components(d).collect()}
    want = brute_lines(texts)
    assert got == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    for i, t in enumerate(texts):
        own = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want or want[i, n][:2] == (i, n))
        if t is None or t == own or own.strip():
            assert kept[i] == own
        else:
            assert i not in kept
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    same = docs(spark, ["one line here and more", None, None], [1, 2, 2]).unionAll(docs(spark, ["one line here and more"], [1]))
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(same).collect()) == [1, 2]


def test_line_dedup_of_shared_and_null_ids(spark):
    """A row loses only its own lines, whatever other rows have its id."""
    for i, first in ((None, None), (7, 3)):
        texts = ["copied from elsewhere\nunique words A", "unique words of B\nother things here", "copied from elsewhere\nlast thing"]
        got = sorted(r.text for r in line_dedup.dedup_lines(docs(spark, [*texts, "copied from elsewhere"], [i, i, i, 3])).collect())
        lines = sorted(x for t in got for x in t.split("\n"))
        assert lines == sorted(["copied from elsewhere", "unique words A", "unique words of B", "other things here", "last thing"]), got
        assert texts[1] in got and (first is None or "copied from elsewhere" in got)


def test_hot_band_keys_are_spread(spark):
    """Spread or not, a bucket has the same members under one name."""
    rng = random.Random(17)
    base = sentence(rng, 30)
    texts = [base + f" {i}" for i in range(60)] + [sentence(rng, 12) for _ in range(40)] + [f"{base} {i}" for i in range(30, 90)]
    d = docs(spark, texts).select("text").repartition(3)

    def groups(most):
        by = collections.defaultdict(set)
        for r in line_dedup.buckets(d, most).collect():
            by[r.group].add(r.id)
        return {frozenset(x) for x in by.values()}

    assert groups(5) == groups(10**9) and max(map(len, groups(5))) >= 90
    clash = docs(spark, ["same line here\nfirst", "same line here\nsecond"]).withColumn("__of", F.lit(1)).withColumn("__row", F.lit("r")).withColumn("__lost", F.lit(2)).withColumn("__Left", F.lit(3)).withColumn("__n", F.lit(4))
    got = line_dedup.dedup_lines(clash)
    assert got.columns == clash.columns and {r.text for r in got.collect()} == {"same line here\nfirst", "second"}


# -- 4 ------------------------------------------------------------------------
def test_ann_recall_and_edges(spark, sf):
    base = table(spark, sf, "embeddings")
    got = collections.defaultdict(list)
    for r in ann.op4_collision_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = base.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    n = np.sqrt((v * v).sum(1))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i] / (n * n[i])
        s[i] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        assert len(got[ids[i]]) == 5 and ids[i] not in dict(got[ids[i]])
        assert all(abs(x - s[list(ids).index(k)]) < 1e-12 for k, x in got[ids[i]])
        hit += len(best & dict(got[ids[i]]).keys())
        total += 5
    assert hit / total >= 0.9
    odd = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [3.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 1.0, 1.0]), (1, [2.0, 0.0])]
    few = spark.createDataFrame(odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = ann.nearest(few, few.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out] == [(0, 1, 1, 1.0), (0, 2, 7, 1.0)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_ann_verifies_few_vectors():
    """On clustered vectors a small share is compared exactly, on uniform ones about a half; both find what brute force finds."""
    rng = np.random.default_rng(30)
    centres = rng.standard_normal((60, 64))
    for v, most in ((np.repeat(centres, 50, axis=0) + 0.3 * rng.standard_normal((3000, 64)), 0.1), (rng.standard_normal((3000, 64)), 0.7)):
        ids = np.arange(3000)
        shard = ann.Shard(ids, v)
        hit, n = 0, 40
        unit = v / np.sqrt((v * v).sum(1))[:, None]
        for q, found, score in shard.search(ids[:: 3000 // n], v[:: 3000 // n], 5):
            i = q * (3000 // n)
            s = unit @ unit[i]
            s[i] = -9
            hit += len(set(np.argsort(-s)[:5]) & set(found))
            assert np.allclose(score, s[found]) and i not in found
        assert hit >= 0.9 * 5 * n
        assert shard.verified / (3000 * n) <= most, shard.verified / (3000 * n)


def test_ann_of_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0]), (0, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(d, d.where("vec_id = 2")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in out] == [(1, 0.773957), (0, 0.707107)]


# -- 2 ------------------------------------------------------------------------
def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.example.net/de/1", None), (2, "https://A.EXAMPLE.net/de/8x?q", ""), (3, "http://example.com/en/7", None), (4, "http://x.com/en/70", None), (5, None, None), (6, "no url", None),
        (7, "http://quiet.test/a", '<link rel="canonical" href="http://b.net/de/z">'), (8, "http://quiet.test/b", "<META http-equiv='refresh' content='0; url=/a'>"),
        (9, "http://free.test/", '<link rel=canonical href="http://free.test/x">'), (10, "http://example.com/en/7?y", '<link rel="canonical" href="http://quiet.test/a">'), (7, "http://quiet.test/a", None), (11, "http://com/en/", None), (12, "http://notcom/en/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1] == ("a.example.net", "/de/1", "net/de/", "block") and got[2] == ("a.example.net", "/de/8x", "example.net/de/8", "allow")
    assert got[3][2:] == ("example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][2:] == (None, "block") == got[8][2:]  # aliases of a blocked url
    assert got[9][3] == "allow" and got[10][2:] == ("example.com/en/7", "allow")  # an explicit allow stands
    assert got[11][2] == "com/en/" and got[12][2] is None
    red = spark.createDataFrame([("http://quiet.test/c", "http://b.net/de/z"), (None, "http://x/")], "from string, to string")
    p = spark.createDataFrame([(1, "http://quiet.test/c#f")], "page_id long, url string")
    assert url_filter.judge(p, redirects=red, html=None).first().verdict == "block"
    assert url_filter.judge(p.limit(0), html=None).count() == 0


def test_url_sql_and_brute_force_over_links(spark):
    """Hubs, chains, relative links, allow precedence: Spark, the SQL and a plain union-find agree."""
    import duckdb

    rng = random.Random(32)
    hosts = ["a.test", "b.test", "x.com", "sub.y.net", "example.com", "z.org"]
    paths = ["/", "", "/en/1", "/en/7", "/de/1", "/es/2", "/p/q", "/p/r?x=1", "/p/#top", "/w"]
    rows, edges = [], []
    url = lambda: rng.choice(["http", "HTTP", "https"]) + "://" + rng.choice([str.upper, str])(rng.choice(hosts)) + rng.choice(paths)
    for i in range(160):
        u, html = url() + rng.choice(["", f"-{i}"]), "<p>text"
        if rng.random() < 0.6:
            to = rng.choice([url(), url() + f"-{rng.randint(0, 159)}", "/p/q", "//b.test/w", "beside", "http://hub.test/all", f"/chain/{i % 20}", f"/chain/{(i + 1) % 20}"])
            html += rng.choice([f"<link rel='canonical' href='{to}'>", f'<LINK data-x="1" rel = canonical href="{to}" >', f"<meta http-equiv=refresh content='0; url={to}'>"])
        rows.append((i, u, html))
    rows += [(900, "http://hub.test/all", '<link rel="canonical" href="http://x.com/en/1">'), (901, None, "<p>"), (902, "no url", None), (5, rows[5][1], rows[5][2])]
    got = sorted(tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(got, key=repr) == sorted(con.sql(url_filter.SQL["op2_url_filter"]).fetchall(), key=repr)

    def norm(u):
        scheme, rest = u.split("://", 1)
        m = re.match("([^/?#]*)([^#]*)", rest)
        return scheme.lower() + "://" + m[1].lower() + (m[2] or "/")

    def said(u):
        m = re.match("([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        h, p = m[1].lower(), m[2]
        fit = [(len(t), k == "allow", k) for k, t in url_filter.RULES if (h == t.split("/")[0] or h.endswith("." + t.split("/")[0])) and p.startswith("/" + t.split("/", 1)[1])]
        return max(fit)[2] if fit else None

    number, uf = {}, components.UnionFind()
    node = lambda u: number.setdefault(norm(u), len(number))
    for _, u, html in rows:
        m = re.search("""(?i)canonical.*?href=["']([^"']+)|url=([^"']+)""", html or "")
        if u and "://" in u and m:
            to = m[1] or m[2]
            root, folder = re.match("[^:]*://[^/?#]*", u)[0], re.match("[^:]*://[^/?#]*(/[^?#]*/|/)?", u)[0]
            to = to if "://" in to else u.split(":")[0] + ":" + to if to.startswith("//") else root + to if to.startswith("/") else (folder if folder.endswith("/") else folder + "/") + to
            edges.append((node(u), node(to)))
            uf.union(*edges[-1])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    bad = {uf.find(i) for u, i in number.items() if i in linked and said(u) == "block"}
    want = {i: said(u) or ("block" if norm(u) in number and number[norm(u)] in linked and uf.find(number[norm(u)]) in bad else "allow") if u and "://" in u else "allow" for i, u, _ in rows}
    assert {r[0]: r[4] for r in got} == want
    assert sum(v == "block" and said(u) is None for (i, u, _), v in zip(rows, map(want.get, (r[0] for r in rows))) if u and "://" in u) > 10


# -- 1 ------------------------------------------------------------------------
def test_license_scan(spark, sf):
    d = table(spark, sf, "documents")
    scanner = licenses.trained(d)
    clean = [r.text for r in d.where("not text rlike '(?i)licen|copyright'").limit(60).collect()]
    rng = random.Random(12)
    hits = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            total += 1
            n, found = scanner.paragraphs(rng.choice(clean)[:300].replace("\n", " ") + "\n" + t.upper() + "\n\nend of it")
            hits += [m[1] for m in found] == [family] and n == 3
    assert hits / total >= 0.9
    assert sum(len(scanner.paragraphs(t)[1]) for t in clean) == 0
    words = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    assert sum(bool(scanner.paragraphs(" ".join(rng.sample(words, 15)))[1]) for _ in range(200)) <= 2
    edge = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in licenses.scan_documents(docs(spark, TEXTS + ["Released under the MIT License.\nReleased under the MIT License."]), scanner).collect()}
    assert edge[0] == (0, 0, "") == edge[1] and edge[len(TEXTS)] == (2, 2, "mit")
    assert licenses.scan(docs(spark, ["x\nReleased under the MIT License."]), scanner).first()[:3] == (0, 1, "mit")
    assert licenses.trained(docs(spark, [])).paragraphs("Released under the MIT License.")[1]


#: Headers as they stand in files: commented, wrapped, reworded; none is a template.
HEADERS = {
    "# SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "/* Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the\n * \"Software\"), to deal in the Software without restriction, including\n * without limitation the rights to use, copy, modify, merge, publish */": "mit",
    "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.": "gpl",
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:": "bsd",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd",
    "-- Permission to use, copy, modify, and distribute this software for any\n-- purpose with or without fee is hereby granted, provided that the above\n-- copyright notice and this permission notice appear in all copies.": "isc",
    "This project is MIT licensed": "mit",
    "; Licensed under the Apache License, Version 2.0 (the \"License\");\n; you may not use this file except in compliance with the License.\n; You may obtain a copy of the License at": "apache-2.0",
    "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this": "mpl-2.0",
}


def test_license_headers_that_were_not_trained_on(spark, sf):
    scanner = licenses.trained(table(spark, sf, "documents"))
    for text, family in HEADERS.items():
        assert [m[1] for m in scanner.paragraphs("int main;\n\n" + text + "\n\nint x;")[1]] == [family], text


def test_license_scan_of_clean_and_odd_texts(spark):
    """False positives on documents without licence wording, over more of them than the sample trained on; and the defined cases."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    scanner = licenses.trained(d, sample=500)
    clean = d.where("not text rlike '(?i)licen|copyright|rights\\\\s+reserved|public\\\\s+domain|SPDX'")
    assert clean.count() > 800 and licenses.scan(clean, scanner).count() == 0
    texts = TEXTS + ["Released under the MIT License.\nReleased under the MIT License."]
    edge = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in licenses.scan_documents(docs(spark, texts), scanner).collect()}
    assert edge[0] == (0, 0, "") == edge[1] and edge[len(TEXTS)] == (2, 2, "mit") and len(edge) == len(texts)
    assert [edge[i][0] for i in range(len(TEXTS))] == [sum(bool(x.encode().split()) for x in (t or "").split("\n")) for t in TEXTS]
    one = licenses.scan_documents(docs(spark, texts).withColumn("families", F.lit(1)).repartition(1), scanner)
    assert {r.doc_id: tuple(r)[1:] for r in one.collect()} == edge == {i: (n, len({m[0] for m in f}), ",".join(sorted({m[1] for m in f}))) for i, (n, f) in enumerate(map(scanner.paragraphs, texts))}
    none = licenses.trained(docs(spark, []))
    assert none.paragraphs("Released under the MIT License.")[1] and licenses.scan_documents(docs(spark, []), none).count() == 0
    words = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    rng = random.Random(12)
    assert sum(bool(scanner.paragraphs(" ".join(rng.sample(words, 15)))[1]) for _ in range(200)) <= 2


def test_windows_cover_every_word():
    rng = random.Random(31)
    size = np.array([rng.choice([1, 2, 7, 8, 9, 23, 24, 25, 100]) for _ in range(50)])
    for wide, step in licenses.WINDOWS:
        a, b = licenses.windows_of(size, wide, step)
        ends = np.cumsum(size)
        assert (b > a).all() and (b - a <= wide).all() and (np.searchsorted(ends, a, side="right") == np.searchsorted(ends, b - 1, side="right")).all()
        assert set(range(ends[-1])) == {w for x, y in zip(a, b) for w in range(x, y)}


def test_license_line_forms(spark, sf):
    scanner = licenses.trained(table(spark, sf, "documents"))
    forms = {
        "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License 2.0": "apache-2.0", "Licensed under the Apache License, Version 1.1": "apache-1.1",
        "Distributed under the MPL 1.1": "mpl-1.1", "Licensed under the GNU LGPL v3": "lgpl", "SPDX-License-Identifier: GPL-2.0-only": "gpl", "// SPDX-License-Identifier: MPL-1.1": "mpl-1.1", "SPDX-License-Identifier: BSD-2-Clause": "bsd",
    }
    for t, family in forms.items():
        assert [m[:2] for m in scanner.paragraphs("Some words.\n" + t)[1]] == [(1, family)], t
    assert [m[1] for m in scanner.paragraphs("# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later WITH Classpath-exception-2.0)")[1]] == ["mit", "gpl"]
    for t in ("Licensed under the Eclipse Public License, v. 2.0", "Licensed under the Artistic License 2.0", "This offer is subject to the terms of the contract", "SPDX-License-Identifier:"):
        assert not scanner.paragraphs(t)[1], t


def test_license_wrapped_and_embedded(spark, sf):
    import textwrap

    scanner = licenses.trained(table(spark, sf, "documents"))
    rng = random.Random(22)
    for family in ("mit", "bsd", "gpl", "apache-2.0"):
        t = max(licenses.TEMPLATES[family], key=len)
        for width in (40, 72, 80):
            for sign in ("", "# ", " * ", "// "):
                text = "\n".join(sign + x for x in ["Some file of ours", "", *textwrap.wrap(t, width), "", "more"]).replace("\n\n", "\n \n")
                assert [m[:2] for m in scanner.paragraphs(text)[1]] == [(2, family)], text
        for n in (30, 150, 600):
            assert [m[:2] for m in scanner.paragraphs(sentence(rng, n) + " " + t + " " + sentence(rng, n))[1]] == [(0, family)]
    assert [m[1] for m in scanner.paragraphs("Permission is hereby granted, free of charge, to any person obtaining a copy")[1]] == ["mit"]
    two = "Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [m[:2] for m in scanner.paragraphs(two)[1]] == [(0, "mit"), (1, "apache-2.0")]
    assert not scanner.paragraphs("All rights\n\nreserved.")[1]


# -- 6 ------------------------------------------------------------------------
def test_revisits(spark):
    rec = Row("record_id", "url", "ts", "kind", "status", "headers", "payload_digest")
    h = lambda **kw: {k.replace("_", "-"): v for k, v in kw.items()}
    rows = [
        rec(1, "http://www.a.test/x?utm_source=f", 10, "response", 200, h(etag='W/"1"', date="d1", content_type="text/html", x="old"), "p1"),
        rec(2, "https://a.test/x#top", 500_000, "response", 200, h(etag='"2"', last_modified="m2"), "p2"),
        rec(3, "http://a.test/x", 20, "revisit", 304, h(etag='"1"', date="d3", content_type="none", x="new"), None),
        rec(4, "http://a.test/x", 500_000, "revisit", 304, h(etag='"1"'), None),  # the response of that second isn't earlier
        rec(5, "http://a.test/x", 900_000, "revisit", 304, h(etag='"1"'), None),
        rec(6, "http://a.test/x", 900_001, "revisit", 304, h(last_modified="m2"), None),
        rec(7, "http://a.test/x", 5, "revisit", 304, h(etag='"1"'), None),
        rec(8, None, 5, "revisit", 304, None, None),
        rec(9, "http://a.test/x", None, "revisit", 304, None, None),
        rec(10, "http://a.test/x", 900_002, "revisit", 200, None, "p2"),
        rec(11, "http://a.test/x", 900_003, "revisit", 304, None, None),
        rec(12, "http://a.test/x", 900_000, "response", 404, h(etag='"1"'), "p9"),
    ]
    kind = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string"
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, kind).withColumn("canonical", F.lit(1))).collect()}
    assert (got[3].refers_to, got[3].outcome, got[3].payload_digest) == (1, "resolved", "p1")
    assert got[3].headers == h(etag='"1"', date="d3", content_type="text/html", x="new")
    assert (got[4].refers_to, got[4].outcome) == (1, "resolved")
    assert (got[5].refers_to, got[5].outcome, got[5].headers) == (2, "mismatch", None)
    assert got[6].payload_digest == "p2" and got[10].outcome == "resolved" and got[11].outcome == "mismatch"
    assert {got[k].outcome for k in (7, 8, 9)} == {"no response"}
    assert warc.resolve(spark.createDataFrame([], kind)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(33)
    rows = []
    for i in range(600):  # one url has most records, many of them at one second
        u = "http://hot.test/" if rng.random() < 0.7 else f"http://b.test/{rng.randint(0, 5)}"
        ts = rng.choice([100, rng.randint(0, 300_000)])
        kind = rng.choice(["response", "revisit"])
        rows.append((i, u, ts, kind, 200 if kind == "response" else 304, {"etag": f'"{rng.randint(0, 2)}"'}, f"p{i}" if kind == "response" else None))
    rows += [rows[3], rows[4]]
    d = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string").withColumn("tb", F.lit(1)).withColumn("own", F.lit(1))
    got = sorted((r.record_id, r.refers_to, r.outcome) for r in warc.resolve(d.repartition(4), bucket=1000).collect())
    want = []
    for i, u, ts, kind, _, h, _ in rows:
        if kind == "revisit":
            best = max(((r[2], r[0], r[5]) for r in rows if r[3] == "response" and r[1] == u and r[2] < ts), default=None, key=lambda x: x[:2])
            want.append((i, best and best[1], "no response" if best is None else "resolved" if best[2] == h else "mismatch"))
    key = lambda x: (x[0], x[1] or -1)
    assert sorted(got, key=key) == sorted(want, key=key)


# -- pipeline -----------------------------------------------------------------
def test_pipeline(spark, sf):
    import corpus_pipeline

    d = table(spark, sf, "documents")
    out = d
    sizes = [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, settled(stage(spark, out, sf))
        assert out.columns == d.columns
        sizes.append(out.count())
        assert out.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            texts = [r.text for r in before.orderBy("doc_id").collect()]
            ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
            assert {r.doc_id for r in out.collect()} == {ids[i] for i, (_, _, c) in brute_join(texts).items() if c == i}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    final = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    assert final.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, empty tables."""
    import corpus_pipeline

    rng = random.Random(34)
    good = [sentence(rng, 40) for _ in range(12)]
    texts = [None, "", " \n", good[0], good[0], good[1] + "\n" + good[2], good[2] + "\n" + good[3], good[4], good[4].upper(), " ".join(sentence(rng, 50) for _ in range(400)), good[5] + "\nshared line of some words", good[6] + "\nshared line of some words"]
    ids = [None, 1, 2, 3, 3, 4, 4, None, 5, 6, None, None]
    rows = [(i, t, None if k % 3 else "en", None, None if k % 2 else 7, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    rows.append(rows[9])
    d = spark.createDataFrame(rows, DOC + ", __row string")
    for c in ("__id", "__of", "__lost", "__left", "__n", "__text", "__stratum", "row", "stratum", "f1", "component", "kept"):
        d = d.withColumn(c, F.lit(1))
    out = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, out, sf))
        assert out.columns == d.columns, name
        assert stage(spark, d.limit(0), sf).count() == 0
        left = [r.text for r in out.collect()]
        if name == "quality_rules":
            assert sorted(left) == sorted(t for t in [r[1] for r in rows] if t and len(t.split()) >= 10)
        if name == "line_dedup":
            lines = [x for t in left for x in t.split("\n")]
            assert len(lines) == len(set(lines)) and {x for t in texts if t and len(t.split()) > 9 for x in t.split("\n")} == set(lines)
    assert sum(r.doc_id == 6 for r in out.collect()) == 1 and {good[4], good[4].upper()} & {r.text for r in out.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    assert packed.groupBy().sum("length").first()[0] == sum(len(load(tokenizer_path("word_bpe_49k.json")).encode(r.text)) + 1 for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, d.limit(0), sf).count() == 0


def test_sql_of_queries(spark, sf):
    import duckdb

    from skeinix.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_stages_give_unused_heap_back(spark, sf, monkeypatch):
    import corpus_pipeline

    def whole_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    at = []
    for module, name in ((quality, "learned"), (line_dedup, "dedup_lines"), (ngram_join, "keep_one"), (packing, "pack")):
        monkeypatch.setattr(module, name, lambda *a, **k: at.append(whole_collections()) or (None, None))
    monkeypatch.setattr(quality, "keep_good", lambda *a, **k: None)
    for name, stage in corpus_pipeline.STAGES:
        before = whole_collections()
        stage(spark, None, sf)
        assert at.pop() > before, name


def test_packing_makes_no_object_of_a_word_that_is_there_again(spark, monkeypatch):
    seen = []

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    class Table:
        def select(self, *a):
            return self

        def mapInArrow(self, fn, schema):
            seen.append(fn)

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(TrieBPE, "cut", lambda self, text: pytest.fail("a list of the words of a text"))
    packing.pack(Table())
    texts = ["the same words, again and again. " * 50] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(seen[0](iter([batch]))).to_pylist()
    monkeypatch.undo()
    ids = np.append(load(tokenizer_path("word_bpe_49k.json")).encode(texts[0]), 1)
    assert sum(r["length"] for r in out) == 40 * len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) for r in out)


def test_packing_gives_freed_memory_back(spark, monkeypatch):
    from skeinix.llm import common

    done, taken = [], []
    monkeypatch.setattr(common, "trim", lambda: done.append(1))

    class Table:
        def select(self, *a):
            return self

        def mapInArrow(self, fn, schema):
            taken.append(fn)

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(packing, "TaskContext", Task)
    packing.pack(Table())
    assert list(taken[0](iter([]))) == [] and done[-1:] == [1]
