"""Analyzers: text to tokens.

``simple``       runs of letters and digits, lower-cased: a JVM expression.
``standard``     word segmentation, lower case, English stems: a vectorised function.
``cjk_bigram``   overlapping pairs of CJK runs, other runs as ``standard``.
``dictionary``   CJK runs by the most probable path through a word graph with an
                 HMM for unknown runs, other runs as ``standard``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DICT_MAX, EngineError
from .stem import stem

CJK = "　-〿぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf"
_SIMPLE = regex.compile(r"[\p{L}\p{N}]+")
_RUNS = regex.compile(f"[{CJK}]+|[^{CJK}]+")
_A = r"[\p{Alphabetic}--[\p{Han}\p{Hiragana}\p{Katakana}]]"
_WORDS = regex.compile(rf"(?V1)[\p{{Han}}\p{{Hiragana}}]\p{{M}}*|[\p{{Katakana}}ー]+|(?:{_A}|\p{{Nd}}|\p{{M}}|_)(?:{_A}|\p{{Nd}}|\p{{M}}|_|(?<={_A}\p{{M}}*)['’.:·‧](?={_A})|(?<=\p{{Nd}})['’.,;](?=\p{{Nd}}))*")


def is_cjk(c: str) -> bool:
    return bool(regex.match(f"[{CJK}]", c))


def simple(text: Column) -> Column:
    """array<string>: maximal runs of letters and digits of the lower-cased text; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _one(text: str) -> str | None:
    """The only word of a text that is Latin letters or ASCII letters and digits within punctuation; None for other texts."""
    t = text.strip('.,;:!?()"')
    return t if t.isascii() and t.isalnum() or t.isalpha() and max(t) < "\u0250" and "\u0130" not in t else None


def simple_tokens(text: str | None) -> list[str]:
    one = _one(text or "")
    return _SIMPLE.findall((text or "").lower()) if one is None else [one.lower()]


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    return stem(word)


def standard_tokens(text: str | None) -> list[str]:
    one = _one(text or "")
    return [_stem(one.lower())] if one is not None else [_stem(w.lower()) for w in _WORDS.findall(text or "") if any(c.isalnum() for c in w)]


def bigram_tokens(text: str | None) -> list[str]:
    out: list[str] = []
    for run in _RUNS.findall(text or ""):
        if is_cjk(run[0]):
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out += standard_tokens(run)
    return out


@dataclass(frozen=True)
class Dictionary:
    """Words with frequencies, user words that override them, and an HMM over B, M, E, S for what the words don't cover."""

    words: dict[str, int]
    user: dict[str, int] = field(default_factory=dict)
    emit: dict[str, dict[str, float]] = field(default_factory=dict)
    start: dict[str, float] = field(default_factory=lambda: {"B": -0.26268660809250016, "S": -1.4652633398537678})
    move: dict[str, dict[str, float]] = field(default_factory=lambda: {"B": {"E": -0.510825623765990, "M": -0.916290731874155}, "E": {"B": -0.5897149736854513, "S": -0.8085250474669937}, "M": {"E": -0.33344856811948514, "M": -1.2603623820268226}, "S": {"B": -0.7211965654669841, "S": -0.6658631448798212}})

    def __post_init__(self):
        if len(self.user) > DICT_MAX:
            raise EngineError("DICT_TOO_LARGE", f"at most {DICT_MAX} words")
        object.__setattr__(self, "longest", max(map(len, [*self.words, *self.user, " "])))
        object.__setattr__(self, "total", math.log(max(1, sum(self.words.values()))))

    def freq(self, w: str) -> int | None:
        return self.user.get(w, self.words.get(w))

    def cut(self, run: str) -> list[str]:
        """The most probable path; among equals the shorter first word (the first candidate) stays."""
        n = len(run)
        best = [(0.0, 0)] * n + [(0.0, 0)]
        for i in range(n - 1, -1, -1):
            ends = [j for j in range(i + 1, min(n, i + self.longest) + 1) if self.freq(run[i:j]) is not None] or [i + 1]
            top = None
            for j in ends:
                p = math.log(max(1, self.freq(run[i:j]) or 0)) - self.total + best[j][0]
                if top is None or p > top[0]:
                    top = (p, j)
            best[i] = top
        out, i, single = [], 0, ""
        while i < n:
            j = best[i][1]
            if j - i == 1:
                single += run[i]
            else:
                out += self._flush(single) + [run[i:j]]
                single = ""
            i = j
        return out + self._flush(single)

    def _flush(self, single: str) -> list[str]:
        if len(single) < 2:
            return [single] if single else []
        if self.freq(single) is not None:
            return list(single)
        return self._hmm(single)

    def _hmm(self, run: str) -> list[str]:
        low = -3.14e100
        e = lambda s, c: self.emit.get(s, {}).get(c, low)
        v = {s: self.start.get(s, low) + e(s, run[0]) for s in "BMES"}
        back = []
        for c in run[1:]:
            step, was = {}, {}
            for s in "BMES":
                p, src = max(((v[r] + self.move.get(r, {}).get(s, low), r) for r in "BMES" if s in self.move.get(r, {})), key=lambda x: x[0])
                step[s], was[s] = p + e(s, c), src
            v = step
            back.append(was)
        state = "E" if v["E"] > v["S"] else "S"
        states = [state]
        for was in reversed(back):
            states.append(was[states[-1]])
        states.reverse()
        out, word = [], ""
        for c, s in zip(run, states):
            word += c
            if s in "ES":
                out.append(word)
                word = ""
        return out + ([word] if word else [])


def dictionary_tokens(text: str | None, d: Dictionary) -> list[str]:
    out: list[str] = []
    for run in _RUNS.findall(text or ""):
        out += d.cut(run) if is_cjk(run[0]) else standard_tokens(run)
    return out


@dataclass(frozen=True)
class Analyzer:
    """A name, tokens of one text, and the column form of that."""

    name: str
    tokens: Callable[[str | None], list[str]]
    column: Callable[[Column], Column]
    user: tuple[tuple[str, int], ...] = ()

    @property
    def id(self) -> str:
        return tokenizer_id(self.name, self.user)


def tokenizer_id(name: str, user: tuple[tuple[str, int], ...] = ()) -> str:
    """sha256 over the algorithm's tag and, for the dictionary one, the length-prefixed user words in order."""
    tag = {"simple": "simple-v1", "standard": "std-v1", "cjk_bigram": "cjk-bigram-v1", "dictionary": "jieba-v1"}[name]
    h = hashlib.sha256(tag.encode())
    if name == "dictionary":
        h.update(b"jieba-fmt-v1")
        for word, freq in user:
            raw = word.encode()
            h.update(len(raw).to_bytes(4, "little") + raw + int(freq).to_bytes(4, "little"))
    return h.hexdigest()


def _vectorised(fn: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    def run(s):
        import pandas as pd

        return pd.Series([fn(None if x is None or x != x else x) for x in s], dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, "array<string>", functionType=F.PandasUDFType.SCALAR)


def analyzer(name: str = "standard", words: dict[str, int] | None = None, user: dict[str, int] | None = None, emit: dict | None = None, degrade: bool = False) -> Analyzer:
    """By name. 'dictionary' needs words; without them it fails, or falls back to cjk_bigram if ``degrade``."""
    user = dict(user or {})
    if len(user) > DICT_MAX:
        raise EngineError("DICT_TOO_LARGE", f"at most {DICT_MAX} words")
    if name == "dictionary" and not words:
        if not degrade:
            raise EngineError("DICT_UNAVAILABLE", "the dictionary analyzer needs a word list")
        name = "cjk_bigram"
    if name == "simple":
        return Analyzer(name, simple_tokens, simple)
    if name == "standard":
        return Analyzer(name, standard_tokens, _vectorised(standard_tokens))
    if name == "cjk_bigram":
        return Analyzer(name, bigram_tokens, _vectorised(bigram_tokens))
    if name == "dictionary":
        d = Dictionary(words, user, emit or {})
        fn = lambda t: dictionary_tokens(t, d)
        return Analyzer(name, fn, _vectorised(fn), tuple(user.items()))
    raise EngineError("INVALID_ARG", f"unknown analyzer {name}")


#: Pieces of texts, and tokens, that a task keeps, and the longest piece kept; they change the speed alone.
PIECES, PIECE = 300_000, 64


class Coded:
    """Texts of a task as numbered tokens.

    No analyzer has a token with white space, nor looks across it, so texts are cut at
    ASCII white space and each distinct piece is analysed once while the table holds it.
    number: of a token, which must stay the same between calls of ``full``; below 0 the
    token counts but isn't returned.
    """

    def __init__(self, tokens: Callable[[str], list[str]], number: Callable[[str], int]):
        self.tokens, self.number, self.known = tokens, number, {}

    def _piece(self, piece: str) -> tuple[int, tuple[int, ...]]:
        found = self.tokens(piece)
        out = (len(found), tuple([n for n in map(self.number, found) if n >= 0]))
        if len(piece) <= PIECE:
            self.known[piece] = out
        return out

    @property
    def full(self) -> bool:
        return len(self.known) >= PIECES

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number) of the tokens in their order, and the count of tokens of each row; null texts have none."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        row = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy())
        codes = pc.list_flatten(cut).dictionary_encode()
        at, known = codes.indices.to_numpy().astype(np.int64), self.known
        pieces = pc.binary_join(pa.ListArray.from_arrays([0, len(codes.dictionary)], codes.dictionary.cast(pa.string())), "\n")[0].as_py().split("\n") if len(codes.dictionary) else []
        found = [known.get(p) or self._piece(p) for p in pieces]
        size = np.fromiter((n for n, _ in found), np.int64, len(found))
        own = np.fromiter((len(x) for _, x in found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(x for _, x in found), np.int64, own.sum())
        n = np.bincount(row, size[at], len(cut)).astype(np.int64)
        times, first = own[at], (np.cumsum(own) - own)[at]
        return np.repeat(row, times), flat[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())], n


class Numbers(dict):
    """Tokens numbered as they come; ``names`` in the order of the numbers."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n

    def names(self) -> pa.Array:
        return pa.array(list(self), pa.string())


def lengths(tokens: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    """Column of texts to the number of their tokens; 0 for null."""

    def run(s):
        import pandas as pd

        coded = Coded(tokens, lambda t: -1)
        return pd.Series(coded(pa.array([x if isinstance(x, str) else None for x in s], pa.string()))[2])

    run.__annotations__ = {}
    return F.pandas_udf(run, "long", functionType=F.PandasUDFType.SCALAR)


def term_counts(texts, tokens: Callable[[str | None], list[str]]):
    """(term, df, cf) of a DataFrame's only column: documents with the term, and its occurrences; counted in the tasks before the one shuffle."""
    if len(texts.columns) != 1:
        raise EngineError("INVALID_ARG", "one column of texts")

    def run(batches):
        numbers = Numbers()
        coded, sums = Coded(tokens, numbers.__getitem__), np.zeros((2, 0), np.int64)

        def done():
            own = np.flatnonzero(sums[0])
            if len(own):
                yield pa.RecordBatch.from_arrays([numbers.names().take(pa.array(own)), pa.array(sums[0][own]), pa.array(sums[1][own])], names=["term", "df", "cf"])

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                row, term, _ = coded(b.column(0).slice(at, 1024))
                both, tf = np.unique(row * max(1, len(numbers)) + term, return_counts=True)
                term = both % max(1, len(numbers))
                sums = np.pad(sums, ((0, 0), (0, len(numbers) - sums.shape[1])))
                sums[0] += np.bincount(term, minlength=len(numbers))
                sums[1] += np.bincount(term, tf, len(numbers)).astype(np.int64)
                if coded.full or len(numbers) >= PIECES:
                    yield from done()
                    numbers.clear()
                    coded.known.clear()
                    sums = np.zeros((2, 0), np.int64)
        yield from done()

    return texts.mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def positions(tokens: Column) -> Column:
    """array<struct<text, position>> of tokens, positions from 0."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("text"), i.alias("position")))


def cjk_bigrams(text: Column) -> Column:
    """The CJK part of ``cjk_bigram`` as a JVM expression: pairs of each CJK run, single characters as they are."""
    runs = F.regexp_extract_all(text, F.lit("[\\u3000-\\u303f\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2ceaf}]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def prune_dictionary(lines, top: int = 200_000):
    """A DataFrame of ``word freq [tag]`` lines (column value) to (word, freq): all single characters, then the ``top`` most frequent longer words; first occurrence wins, frequency 0 goes."""
    from pyspark.sql import Window

    parts = F.split(F.trim("value"), "\\s+")
    d = lines.select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).cast("long").alias("freq"), F.monotonically_increasing_id().alias("at")).where("freq > 0 and length(word) > 0")
    first = d.groupBy("word").agg(F.min_by("freq", "at").alias("freq"), F.min("at").alias("at"))
    longer = first.where("length(word) > 1").orderBy(F.desc("freq"), "at").limit(top)
    del Window
    return first.where("length(word) = 1").unionByName(longer).select("word", "freq")
