"""Operator 9: quality rules with risk-controlled thresholds.

Every text gets counts (``features``).  Fixed base rules reject the hopeless; the
other rules reject a document whose score is above a cutoff learned from labels.
For each stratum a sequence of sets of cutoffs, each stricter than the one before, is
laid out from the rows that aren't labelled good (``sequence``).  It is walked on the
good ones (label 1) for as long as the share of them that the set rejects, by all
rules together, is by the exact binomial (Clopper-Pearson) bound at most ``risk``.
Testing in a fixed sequence needs no division of the level; ``miss`` is divided by the
number of strata that have labels enough to show anything (``able``), so with
probability 1 - miss no stratum loses more than ``risk`` of its good documents to the
learned rules.  A stratum with too few labels gets no cutoff and keeps everything.

Only distinct texts are trials of the bound: label rows of one document count once, and
so do labelled documents of one stratum with the same text (good, if any label says so,
which can only make the bound stricter), since copies aren't independent.

Defined cases: null text has no words (and fails the base); null stratum is the
stratum ''; strata of any type go by Spark's cast to string; null keys or labels don't
take part in fitting; rows that repeat give repeated rows; very long texts are counted
whole; a score equal to a cutoff passes; an empty table gives an empty result; other
columns pass through ``keep_good`` whatever their names and are ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, fresh_names, settled, slices, table, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Scores: the share of symbols, of repeated lines, of words in repeated windows, of capitals; and characters a word.
RULES = ["symbols", "dup_lines", "repeats", "upper", "word_length"]
GRID = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5],
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeats": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18],
    "upper": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "word_length": [8, 9, 10, 12, 15, 20, 30],
}
_BLANK, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text.  Repeated words are the positions covered by 5-word windows found twice or more."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    n_repeat = 0
    if n > 5:
        w = windows(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 5)
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(w, twice))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            n_repeat = int((np.cumsum(edge) > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = int(((c - 65 < 26) | ((c - 192 < 31) & (c != 215))).sum())  # A-Z and the capitals of Latin-1
    return n, len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), n_repeat, len(lines), upper


def scores(f: pd.DataFrame) -> pd.DataFrame:
    """RULES from COUNTS."""
    chars, words = f.word_chars.clip(lower=1), f.n_words.clip(lower=1)
    return pd.DataFrame({"symbols": f.n_symbols / chars, "dup_lines": f.n_dup_lines / f.n_lines.clip(lower=1), "repeats": f.n_repeat_words / words, "upper": f.n_upper / chars, "word_length": f.word_chars / words})


def base_failed(f):
    return (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)


def features(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per row: key, stratum, row (a hash of the text), COUNTS, base_failed and the index of each score in its grid (how many cutoffs it exceeds)."""

    def run(batches):
        claim("quality")
        for b in slices(batches):
            yield _counted(b)

    kinds = ", ".join([f"{c} long" for c in COUNTS] + ["base_failed boolean"] + [f"b_{r} int" for r in RULES])
    own = F.col(text).cast("string")
    return df.select(F.col(key).cast("long").alias("doc_id"), _stratum(stratum).alias("stratum"), F.xxhash64(own).alias("row"), own.alias("text")).mapInArrow(run, f"doc_id long, stratum string, row long, {kinds}")


def _stratum(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of (key, stratum, row, text)."""
    f = pd.DataFrame([counts(t) for t in b.column(3).to_pylist()], columns=COUNTS)
    s = scores(f)
    over = [np.searchsorted(GRID[r], s[r].to_numpy(), side="left") for r in RULES]
    cols = [b.column(0), b.column(1), b.column(2), *(pa.array(f[c], pa.int64()) for c in COUNTS), pa.array(base_failed(f), pa.bool_()), *(pa.array(o, pa.int32()) for o in over)]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "stratum", "row", *COUNTS, "base_failed", *(f"b_{r}" for r in RULES)])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    m = lg.max()
    return float(min(1.0, math.exp(m) * np.exp(lg - m).sum()))


def shown(k: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound (confidence 1 - level) on the share, k of n seen, is at most risk."""
    return n > 0 and k <= risk * n and binomial_tail(k, n, risk) <= level


def able(sizes: list[tuple[int, int]], risk: float, miss: float) -> int:
    """How many strata could show the risk at level miss / that number with no good document rejected; sizes: (good labels, strata that have as many)."""
    m = 0
    for n, strata in sorted(sizes, reverse=True):
        m += min(strata, max(0, int(miss / (1 - risk) ** n if n * -math.log1p(-risk) < 300 else strata + m) - m))
    return m


def sequence(bins: np.ndarray, junk: np.ndarray, other: np.ndarray) -> list[list[int]]:
    """Sets of cutoffs (one a rule), each stricter than the one before.

    bins: (cells, rules) of the rows not labelled good, of which junk are labelled bad
    and other have no label.  First come the steps that reject the most junk for the
    other rows they reject, then the remaining ones, loosest first, all rules in turn.
    """
    sizes = [len(GRID[r]) for r in RULES]
    cut, out, kept = list(sizes), [], np.ones(len(bins), bool)
    while (kept & (junk > 0)).any():
        best = None
        for k, n in enumerate(cut):
            for c in range(n):
                hit = kept & (bins[:, k] > c)
                gain = int(junk[hit].sum())
                if gain and (best is None or (gain / (1 + other[hit].sum()), gain, c) > best[0]):
                    best = (gain / (1 + other[hit].sum()), gain, c), k, c
        if best is None:
            break
        cut[best[1]] = best[2]
        kept &= bins[:, best[1]] <= best[2]
        out.append(list(cut))
    for _, k, c in sorted((1 - c / sizes[k], k, c) for k in range(len(sizes)) for c in range(cut[k])):
        cut[k] = c
        out.append(list(cut))
    return out


def fit(feats: DataFrame, labels: DataFrame, risk: float = 0.01, miss: float = 0.05, key: str = "doc_id", good: str = "quality") -> DataFrame:
    """Cutoffs: (stratum, rule, cut), a document failing a rule if its index in the grid is above cut.

    feats: what ``features`` gives.  All rows that pass the base rules count; what moves is the joint histogram of the
    rules' grids in each stratum (some 50,000 cells at most), combined before the shuffle.
    """
    marked = labels.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max((F.col(good) == 1).cast("int")).alias("g"), F.max((F.col(good) == 0).cast("int")).alias("j")).where("doc_id is not null and (g = 1 or j = 1)")
    bins = [f"b_{r}" for r in RULES]
    clean = feats.where(~F.col("base_failed")).join(marked, "doc_id", "left")
    trials = clean.where("g is not null").groupBy("stratum", "row", *bins).agg(F.max("g").alias("g"))
    trials = trials.groupBy("stratum", *bins).agg(F.sum("g").cast("long").alias("good"), F.sum(1 - F.col("g")).cast("long").alias("junk"), F.lit(0).cast("long").alias("other"))
    rest = clean.where("g is null").groupBy("stratum", *bins).agg(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("junk"), F.count("*").alias("other"))
    seen = settled(trials.unionByName(rest).groupBy("stratum", *bins).agg(*(F.sum(c).alias(c) for c in ("good", "junk", "other"))))
    strata = seen.groupBy("stratum").agg(F.sum("good").alias("n")).where("n > 0").groupBy("n").count().collect()
    level = miss / max(1, able([(r["n"], r["count"]) for r in strata], risk, miss))

    def choose(t: pa.Table) -> pa.Table:
        at = np.stack([t[b].to_numpy() for b in bins], axis=1)
        n, junk, other = (t[c].to_numpy() for c in ("good", "junk", "other"))
        chosen = [len(GRID[r]) for r in RULES]
        if shown(0, int(n.sum()), risk, level):
            for cut in sequence(at, junk, other):
                if not shown(int(n[(at > np.array(cut)).any(axis=1)].sum()), int(n.sum()), risk, level):
                    break
                chosen = cut
        rows = [{"stratum": t["stratum"][0].as_py(), "rule": r, "cut": c} for r, c in zip(RULES, chosen) if c < len(GRID[r])]
        return pa.Table.from_pylist(rows, schema=pa.schema([("stratum", pa.string()), ("rule", pa.string()), ("cut", pa.int32())]))

    return seen.groupBy("stratum").applyInArrow(choose, "stratum string, rule string, cut int")


MOST_STRATA = 100_000


def cutoffs(chosen: DataFrame, most_strata: int = MOST_STRATA) -> dict[str, list[int]]:
    """Fitted cutoffs on the driver, one row a stratum and at most len(RULES) numbers in it; refused beyond a checked size."""
    n = 1 << 30
    rows = chosen.limit(most_strata * len(RULES) + 1).collect()
    if len(rows) > most_strata * len(RULES):
        raise ValueError("too many strata for a table on the driver; keep_good() and verdicts() take the fitted rows themselves")
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.stratum, [n] * len(RULES))[RULES.index(r.rule)] = r.cut
    return out


def verdicts(feats: DataFrame, chosen: DataFrame) -> DataFrame:
    """feats with kept; the join's small side is broadcast only where Spark finds it small."""
    wide = chosen.groupBy("stratum").pivot("rule", RULES).agg(F.first("cut"))
    wide = wide.select("stratum", *(F.col(r).alias(f"c_{r}") for r in RULES))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(f"b_{r}") > F.col(f"c_{r}"), F.lit(False))
    return feats.join(wide, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~bad).drop(*(f"c_{r}" for r in RULES))


def keep_good(df: DataFrame, cuts: dict[str, list[int]] | DataFrame, text: str = "text", stratum: str = "lang", most_strata: int = MOST_STRATA) -> DataFrame:
    """The rows of df that pass; columns as they were.

    cuts: from ``cutoffs``, or the fitted rows: these go with the function where they are
    of at most ``most_strata`` strata, so that no text is shuffled, and are joined by
    stratum where they are more.
    """
    names = df.columns
    if isinstance(cuts, DataFrame):
        if cuts.limit(most_strata * len(RULES) + 1).count() > most_strata * len(RULES):
            return _keep_joined(df, cuts, text, stratum)
        cuts = cutoffs(cuts, most_strata)
    own, by = fresh_names(df, "text", "stratum")

    def run(batches):
        claim("quality")
        for b in slices(batches):
            n = b.num_columns
            f = _counted(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(n - 1), pa.nulls(b.num_rows, pa.int64()), b.column(n - 2)], names=["a", "b", "c", "d"])).to_pandas()
            limit = np.array([cuts.get(x, [1 << 30] * len(RULES)) for x in f.stratum]).reshape(-1, len(RULES))
            bad = (f[[f"b_{r}" for r in RULES]].to_numpy() > limit).any(axis=1) | f.base_failed.to_numpy()
            kept = b.filter(pa.array(~bad))
            yield pa.RecordBatch.from_arrays(kept.columns[: n - 2], names=names)

    return df.withColumn(own, F.col(text).cast("string")).withColumn(by, _stratum(stratum)).mapInArrow(run, df.schema)


def _keep_joined(df: DataFrame, chosen: DataFrame, text: str, stratum: str) -> DataFrame:
    own, by, failed, *over = fresh_names(df, "text", "stratum", "failed", *RULES)

    def run(batches):
        claim("quality")
        for b in slices(batches):
            n = b.num_columns
            f = _counted(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(n - 1), pa.nulls(b.num_rows, pa.int64()), b.column(n - 2)], names=["a", "b", "c", "d"]))
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], b.column(n - 1), *f.columns[-len(RULES) - 1 :]], names=[*b.schema.names[: n - 2], by, failed, *over])

    kinds = T.StructType([*df.schema.fields, T.StructField(by, T.StringType()), T.StructField(failed, T.BooleanType()), *(T.StructField(c, T.IntegerType()) for c in over)])
    d = df.withColumn(own, F.col(text).cast("string")).withColumn(by, _stratum(stratum)).mapInArrow(run, kinds).where(~F.col(failed))
    limits = fresh_names(d, *(f"c_{r}" for r in RULES))
    other = fresh_names(d, "of")[0]
    wide = chosen.groupBy("stratum").pivot("rule", RULES).agg(F.first("cut")).select(F.col("stratum").alias(other), *(F.col(r).alias(c) for r, c in zip(RULES, limits)))
    bad = F.lit(False)
    for o, c in zip(over, limits):
        bad = bad | F.coalesce(F.col(o) > F.col(c), F.lit(False))
    return d.join(wide, F.col(by) == F.col(other), "left").where(~bad).select(*df.columns)


def learned(docs: DataFrame, labels: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Features of all rows (written once) and the cutoffs."""
    feats = settled(features(docs))
    return feats, settled(fit(feats, labels, **kw))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, chosen = learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts(feats, chosen).select("doc_id", *COUNTS[:5], "base_failed", "kept")
