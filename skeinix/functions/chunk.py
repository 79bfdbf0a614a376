"""Chunks of documents: markdown sections, overflow splitting, overlap, breadcrumbs.

Sizes are code points, offsets bytes of UTF-8.  The overlap is the tail of the
chunk before as it was emitted, so chunks of a document are made in one pass; the
documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EngineError

SCHEMA = "text string, headings array<string>, start_byte long, end_byte long, chunk_index int"
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t].*)?", re.S)
_SETEXT = re.compile(r" {0,3}(=+|-+)\s*")


@dataclass(frozen=True)
class ChunkConfig:
    split: str = "markdown"
    max_chars: int = 1200
    overlap_chars: int = 200
    min_chars: int = 50

    def __post_init__(self):
        if self.split not in ("markdown", "plain"):
            raise EngineError("INVALID_ARG", f"unknown split {self.split}")
        if self.max_chars < 1 or not 0 <= self.overlap_chars < self.max_chars or self.min_chars > self.max_chars:
            raise EngineError("INVALID_ARG", "chunk sizes don't fit together")


def headings(src: str) -> list[tuple[int, int, str]]:
    """(start, level, title) of ATX and setext headings."""
    out, at, above = [], 0, None
    for raw in src.splitlines(keepends=True) if "\x0b" not in src and "\x0c" not in src and src.isascii() else re.findall(r"[^\n]*\n|[^\n]+", src):
        line = raw[:-2] if raw.endswith("\r\n") else raw[:-1] if raw.endswith("\n") else raw
        under, own = _SETEXT.fullmatch(line), _ATX.fullmatch(line)
        if under and above and above[1].strip() and not _ATX.fullmatch(above[1]):
            out.append((above[0], 1 if under[1][0] == "=" else 2, above[1].strip()))
            above = None
        elif own:
            rest = line.lstrip(" ")[len(own[1]) :].strip()
            out.append((at, len(own[1]), "" if set(rest) <= {"#"} else rest.rstrip("#").rstrip()))
            above = None
        else:
            above = (at, line)
        at += len(raw)
    return out


def sections(src: str) -> list[tuple[int, int, list[str]]]:
    marks = headings(src)
    if not marks:
        return [(0, len(src), [])]
    out = [(0, marks[0][0], [])] if marks[0][0] else []
    path: list[tuple[int, str]] = []
    for (start, level, title), end in zip(marks, [m[0] for m in marks[1:]] + [len(src)]):
        path = [p for p in path if p[0] < level] if not path or path[-1][0] >= level else path
        path = [*path, (level, title)]
        out.append((start, end, [t for _, t in path]))
    return out


def pieces(src: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Blank-line blocks, then lines, then hard cuts, packed greedily up to ``most``."""
    if end - start <= most:
        return [(start, end)] if end > start else []
    units: list[tuple[int, int]] = []
    for block in re.finditer(r"(?s).+?(?:\n[ \t\r]*\n|\Z)", src[start:end]):
        a, b = start + block.start(), start + block.end()
        if b - a <= most:
            units.append((a, b))
            continue
        for line in re.finditer(r"[^\n]*\n|[^\n]+", src[a:b]):
            x, y = a + line.start(), a + line.end()
            units += [(c, min(c + most, y)) for c in range(x, y, most)]
    out: list[tuple[int, int]] = []
    for a, b in units:
        if out and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def chunk_text(src: str, cfg: ChunkConfig) -> list[tuple[str, list[str], int, int, int]]:
    """(text, headings, start byte, end byte, index) of each chunk."""
    parts = sections(src) if cfg.split == "markdown" else [(0, len(src), [])]
    found = [(a, b, h) for s, e, h in parts for a, b in pieces(src, s, e, cfg.max_chars)]
    if len(found) > 1:
        found = [p for p in found if p[1] - p[0] >= cfg.min_chars]
    at = None if src.isascii() else [0, *accumulate(1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in src)]
    out, body = [], ""
    for i, (a, b, h) in enumerate(found):
        body = (body[-cfg.overlap_chars :] if i and cfg.overlap_chars else "") + src[a:b]
        out.append((" > ".join(h) + "\n" + body if h else body, h, a if at is None else at[a], b if at is None else at[b], i))
    return out


def chunks(df: DataFrame, cfg: ChunkConfig = ChunkConfig(), text: str = "text", keep: tuple[str, ...] = ("id",), plain: str | None = None) -> DataFrame:
    """The kept columns and SCHEMA, a row a chunk. plain: a boolean column of texts to split as plain ones (HTML)."""
    kept = df.select(*keep).schema
    flat = ChunkConfig("plain", cfg.max_chars, cfg.overlap_chars, cfg.min_chars)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(i, *c) for i, (t, p) in enumerate(zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist())) if t is not None for c in chunk_text(t, flat if p else cfg)]
                own = part.select(list(range(len(keep)))).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=[*keep, "text", "headings", "start_byte", "end_byte", "chunk_index"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept.fields, *_parse_datatype_string(SCHEMA).fields])
    picked = df.select(*keep, F.col(text).alias("__text"), (F.lit(False) if plain is None else F.coalesce(F.col(plain), F.lit(False))).alias("__plain"))
    return picked.mapInArrow(run, schema)


def chunker(cfg: ChunkConfig = ChunkConfig()):
    """The same as a table function, for SQL: spark.udtf.register('chunks', chunker())."""
    from pyspark.sql.functions import udtf

    class Chunker:
        def eval(self, text: str):
            if text is not None:
                yield from chunk_text(text, cfg)

    return udtf(Chunker, returnType=SCHEMA)
