"""Operator 8: token counts that follow edits.

A document is kept as the lengths and token counts of its pre-tokens, in blocks, with
a segment tree over the blocks that holds characters and tokens; ``build_trees``
stores that beside the text, ``count_edits`` and ``apply_edits`` go on from what is
stored.  An edit finds its block by descending the tree and cuts anew from the nearest
pre-token whose match can't have seen the edit (``margin``: it isn't white space and
ends that many characters before) up to the first place behind the edit where old and
new cuts meet: from there on both are the same, since how a text is cut depends on what
follows alone.  Only what lies between is encoded, and only the sums on the paths above
the blocks that changed are renewed.

Defined cases: null text is empty; an edit beyond the end is clipped to it; null or
empty lists of edits, and null edits in a list, change nothing; a null replacement
deletes; edits are applied in the order of the list, each to the text as the ones before
left it; special tokens may come and go by edits; very long texts are taken apart whole,
a piece at a time; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored by ``count_edits`` and pass through ``build_trees`` and
``apply_edits`` whatever their names (a column of the name to be added is refused).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PIECE, TrieBPE, load, tokenizer_path
from .common import slices, table

BLOCK, WINDOW = 64, 48
EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"


class CountedText:
    """A text whose token count is kept up to date; tree: what ``stored`` gave for this text; parts: its pre-tokens, where they are known."""

    def __init__(self, text: str, bpe: TrieBPE, tree: bytes | None = None, parts: list[str] | None = None):
        if bpe.lower:
            raise ValueError("needs a vocabulary whose pre-tokens make up the text")
        self.text, self.bpe, self.reencoded = text, bpe, 0
        # a match looks three characters ahead at most, and a special token as far as it is long
        self.margin = 4 + max(map(len, bpe.special), default=0)
        if tree is None:
            self._encode(parts)
        else:
            self._restore(tree)

    def _encode(self, known: list[str] | None) -> None:
        sizes, counts = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for parts in (known,) if known is not None else map(self.bpe.parts, self.bpe.pieces(self.text)):
            sizes.append(np.fromiter(map(len, parts), np.uint32, len(parts)))
            counts.append(np.array(self.bpe.counts(parts), np.uint32))
        self.sizes, self.counts = np.concatenate(sizes), np.concatenate(counts)
        self._plant()

    def _plant(self) -> None:
        """The tree over what sizes and counts hold."""
        n = len(self.sizes)
        blocks = max(1, -(-n // BLOCK))
        self.first = np.minimum(np.arange(blocks + 1) * BLOCK, n)
        self.leaves = 1 << (blocks - 1).bit_length()
        self.chars, self.tokens = self._sums(self.sizes), self._sums(self.counts)

    def _sums(self, of: np.ndarray) -> list[int]:
        level = np.zeros(self.leaves, np.int64)
        if len(of):
            level[: len(self.first) - 1] = np.add.reduceat(of.astype(np.int64), self.first[:-1])
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def stored(self) -> bytes:
        """Blocks, tree, lengths and counts."""
        head = np.array([len(self.sizes), len(self.first), self.leaves], np.int64)
        small = [a.astype(np.uint8 if not len(a) or a.max() < 256 else np.uint32) for a in (self.sizes, self.counts)]
        widths = np.array([a.itemsize for a in small], np.int64)
        return b"".join(a.tobytes() for a in (head, widths, self.first.astype(np.int64), np.array(self.chars, np.int64), np.array(self.tokens, np.int64), *small))

    def _restore(self, tree: bytes) -> None:
        n, blocks, self.leaves, *widths = np.frombuffer(tree, np.int64, 5).tolist()
        rest = np.frombuffer(tree, np.int64, blocks + 4 * self.leaves, 40)
        self.first = rest[:blocks]
        self.chars, self.tokens = rest[blocks : blocks + 2 * self.leaves].tolist(), rest[blocks + 2 * self.leaves :].tolist()
        at, found = 40 + 8 * len(rest), []
        for w in widths:
            found.append(np.frombuffer(tree, np.uint8 if w == 1 else np.uint32, n, at).astype(np.uint32))
            at += n * w
        self.sizes, self.counts = found

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last block for the end), and where that block begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        block = node - self.leaves
        while block > len(self.first) - 2:
            block -= 1
            begin -= self.chars[self.leaves + block]
        return block, begin

    def _before(self, at: int) -> tuple[int, int]:
        """The first pre-token that may have to be cut anew for a change at ``at``, and where it begins."""
        block, begin = self._find(max(0, at - self.margin))
        while True:
            ends = begin + np.cumsum(self.sizes[self.first[block] : self.first[block + 1]], dtype=np.int64)
            for k in range(int(np.searchsorted(ends, at - self.margin, side="right")) - 1, -1, -1):
                if not self.text[ends[k] - 1].isspace():
                    return int(self.first[block]) + k + 1, int(ends[k])
            if not block:
                return 0, 0
            block -= 1
            begin -= self.chars[self.leaves + block]

    def edit(self, start: int, length: int, replacement: str | None) -> None:
        new, old = replacement or "", self.text
        size = len(old)
        start = min(max(0, start), size)
        end = min(start + max(0, length), size)
        if start == end and not new:
            return
        shift = len(new) - (end - start)
        i, begin = self._before(start)
        self.text = old[:start] + new + old[end:]
        wide = WINDOW
        while True:
            stop = min(size, end + self.margin + wide)
            fresh = self.bpe.parts(self.text[begin : stop + shift])
            # old cuts from the end of the edit on, as far as the window goes
            at, j, known = begin, i, {}
            if at >= end:
                known[at] = j
            while at < stop and j < len(self.sizes):
                for n in self.sizes[j : j + BLOCK].tolist():
                    at += n
                    j += 1
                    if at >= end:
                        known[at] = j
                    if at >= stop:
                        break
            safe = size + shift if stop == size else stop + shift - self.margin
            at, keep, last = begin, len(fresh), None
            for k, part in enumerate(fresh, 1):
                at += len(part)
                if at > safe:
                    break
                if (last := known.get(at - shift)) is not None and at >= start + len(new):
                    keep = k
                    break
            if last is not None or stop == size:
                break
            wide *= 4
        j = len(self.sizes) if last is None else last
        fresh = fresh[:keep]
        self.reencoded += len(fresh)
        self._splice(i, j, np.array([len(x) for x in fresh], np.uint32), np.array(self.bpe.counts(fresh), np.uint32))

    def _splice(self, i: int, j: int, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Put pre-tokens in the place of those from i to j, and renew the sums above them."""
        self.sizes = np.concatenate([self.sizes[:i], sizes, self.sizes[j:]])
        self.counts = np.concatenate([self.counts[:i], counts, self.counts[j:]])
        blocks = len(self.first) - 1
        low = min(blocks - 1, max(0, int(np.searchsorted(self.first, i, side="right")) - 1))
        high = min(blocks, max(low + 1, int(np.searchsorted(self.first, j, side="left"))))
        grown = len(sizes) - (j - i)
        a, b = int(self.first[low]), int(self.first[high]) + grown
        if b - a > 4 * BLOCK * (high - low):
            self._plant()  # too much for the blocks there are
            return
        first = self.first.copy()
        first[high:] += grown
        first[low : high + 1] = np.linspace(a, b, high - low + 1).astype(np.int64)
        self.first = first
        for k in range(low, high):
            self._set(k, int(self.sizes[first[k] : first[k + 1]].sum()), int(self.counts[first[k] : first[k + 1]].sum()))

    def _set(self, block: int, chars: int, tokens: int) -> None:
        node = self.leaves + block
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def _opened(bpe: TrieBPE, texts: list[str | None], trees: list[bytes | None]) -> list[CountedText]:
    """The texts with their trees; what has none is encoded, the new pre-tokens of all such texts at once."""
    cut = [bpe.parts(t) if t and tree is None and len(t) < PIECE else None for t, tree in zip(texts, trees)]
    bpe.learn(set().union(*filter(None, cut)))
    return [CountedText(t or "", bpe, tree, parts) for t, tree, parts in zip(texts, trees, cut)]


def _edit_all(c: CountedText, edits) -> None:
    for e in edits or []:
        if e is not None:
            c.edit(e["start"] or 0, e["length"] or 0, e["replacement"])


def build_trees(df: DataFrame, text: str = "text", to: str = "tree", path: str | None = None) -> DataFrame:
    """df and a binary column with the tree of each text."""
    if to in df.columns:
        raise ValueError(f"there is a column {to} already")
    path, at = path or tokenizer_path("byte_bpe_50k.json"), df.columns.index(text)

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            trees = [c.stored() for c in _opened(bpe, texts, [None] * len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees, pa.binary())], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def apply_edits(df: DataFrame, text: str = "text", edits: str = "edits", tree: str = "tree", path: str | None = None) -> DataFrame:
    """df with text and tree as the edits leave them (a null tree is built); null texts become what the edits make of an empty one."""
    path, (t, e, k) = path or tokenizer_path("byte_bpe_50k.json"), (df.columns.index(c) for c in (text, edits, tree))

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            found = _opened(bpe, b.column(t).to_pylist(), b.column(k).to_pylist())
            for c, own in zip(found, b.column(e).to_pylist()):
                _edit_all(c, own)
            cols = list(b.columns)
            cols[t], cols[k] = pa.array([c.text for c in found], pa.string()), pa.array([c.stored() for c in found], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))


def count_edits(df: DataFrame, key: str = "doc_id", text: str = "text", edits: str = "edits", path: str | None = None, tree: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, n_tokens_after (the edits), n_chars_after, n_reencoded (pre-tokens cut and counted anew).

    tree: a column that ``build_trees`` made of text; without it texts are encoded first.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            out = []
            for c, own in zip(_opened(bpe, b.column(1).to_pylist(), b.column(3).to_pylist()), b.column(2).to_pylist()):
                before = c.n_tokens
                _edit_all(c, own)
                out.append((before, c.n_tokens, c.chars[1], c.reencoded))
            cols = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols)], names=["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_reencoded"])

    own = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(edits).cast(EDITS).alias("edits"), (F.col(tree) if tree else F.lit(None)).cast("binary").alias("tree"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_reencoded long")


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): three edits a document, at places set by its id and length."""
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    i = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    edit = lambda start, length, new: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), new.alias("replacement"))
    return docs.select("doc_id", "text", F.array(edit(F.floor(n / 3), F.lit(0), F.concat(F.lit(" [note "), i.cast("string"), F.lit("] "))), edit(F.floor(n * 2 / 3), F.pmod(i, F.lit(40)), F.lit("")), edit(F.pmod(i * 7919, n + 1), F.lit(5), F.lit("über 12")))
        .alias("edits"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(with_edits(table(spark, sf_dir, "documents")))
