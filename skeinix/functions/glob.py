"""Glob predicates and file classification, compiled on the driver to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import normal_path

EXTRACTORS = ("text", "image")


def alternatives(pattern: str) -> list[str]:
    """A pattern without its {a,b} groups (nested ones too); an open brace without its end is a plain character."""
    for m in re.finditer(r"\{", pattern):
        depth, start, parts = 0, m.end(), []
        for i in range(m.start(), len(pattern)):
            c = pattern[i]
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 1:
                parts.append(pattern[start:i])
                start = i + 1
            elif c == "}" and depth == 0:
                parts.append(pattern[start:i])
                return [x for p in parts for x in alternatives(pattern[: m.start()] + p + pattern[i + 1 :])]
    return [pattern]


def _segment(seg: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in seg)


def _one(pattern: str) -> str:
    segs = [s for s in pattern.split("/") if s and s != "."]
    segs = [s for i, s in enumerate(segs) if not (s == "**" and i and segs[i - 1] == "**")]
    if not segs:
        return ""
    if segs == ["**"]:
        return ".*"
    out = ""
    for i, s in enumerate(segs):
        last = i == len(segs) - 1
        if s != "**":
            out += _segment(s) + ("" if last else "/" if segs[i + 1 :] != ["**"] else "")
        elif last:
            out += "(?:/.*)?"
        else:
            out += "(?:[^/]+/)*"
    return out


def regex_of(pattern: str) -> str:
    """One expression for a whole normalised path."""
    return "(?s)^(?:" + "|".join(_one(p) for p in alternatives(pattern)) + ")$"


def glob(path: Column, pattern: str) -> Column:
    return normal_path(path).rlike(regex_of(pattern))


def glob_match(pattern: str, path: str) -> bool:
    return bool(re.search(regex_of(pattern), "/".join(s for s in path.split("/") if s and s != ".")))


@dataclass(frozen=True)
class TypeRule:
    glob: str
    extractor: str = "text"
    enabled: bool = True


@dataclass(frozen=True)
class Policy:
    """What to index. ``types`` in order: the first enabled rule that fits decides."""

    exclude: tuple[str, ...] = ("**/.git/**", "**/node_modules/**", "**/.env", "**/.env.*")
    types: tuple[TypeRule, ...] = (TypeRule("**/*.{md,markdown,txt,html,htm}"), TypeRule("**/*.{png,jpg,jpeg,webp,gif}", "image"), TypeRule("**/*.pdf", "pdf", False))
    split: str = "markdown"
    max_chars: int = 1200
    overlap_chars: int = 200
    min_chars: int = 50

    def over(self, exclude: tuple[str, ...] = (), types: tuple[TypeRule, ...] | None = None, include: tuple[str, ...] | None = None, **fields) -> Policy:
        """A narrower layer: excludes add up in order, types replace, else include makes text rules, single fields replace."""
        rules = types if types is not None else tuple(TypeRule(g) for g in include) if include is not None else self.types
        base = {k: getattr(self, k) for k in ("split", "max_chars", "overlap_chars", "min_chars")} | {k: v for k, v in fields.items() if v is not None}
        return Policy(tuple(dict.fromkeys([*self.exclude, *exclude])), rules, **base)


def provenance(layers: dict[str, dict]) -> dict[str, str]:
    """Which layer (in order, the last one that sets it) each section comes from; secrets aren't part of it."""
    out: dict[str, str] = {}
    for name, section in layers.items():
        for k, v in section.items():
            if v is not None and k != "api_key":
                out[k] = name
    return out


def classify(path: Column, policy: Policy) -> Column:
    """struct(extractor, skip): the extractor, or why a path is skipped (excluded, disabled, no_type)."""
    p = normal_path(path)
    out = F.lit(None).cast("string")
    excluded = F.lit(False)
    for g in policy.exclude:
        excluded = excluded | p.rlike(regex_of(g))
    seen = F.lit(False)
    what, skip = F.lit(None).cast("string"), F.lit("no_type")
    for r in policy.types:
        if not r.enabled:
            seen = seen | p.rlike(regex_of(r.glob))
    skip = F.when(seen, "disabled").otherwise(skip)
    for r in reversed([r for r in policy.types if r.enabled]):
        fits, good = p.rlike(regex_of(r.glob)), r.extractor in EXTRACTORS
        what = F.when(fits, F.lit(r.extractor) if good else out).otherwise(what)
        skip = F.when(fits, F.lit(None).cast("string") if good else F.lit("disabled")).otherwise(skip)
    return F.struct(F.when(excluded, out).otherwise(what).alias("extractor"), F.when(excluded, "excluded").otherwise(skip).alias("skip"))


def unsupported(path: Column, policy: Policy) -> Column:
    """The extractor of the first enabled rule that fits, if it is none that exists here."""
    p = normal_path(path)
    out = F.lit(None).cast("string")
    for r in reversed([r for r in policy.types if r.enabled]):
        out = F.when(p.rlike(regex_of(r.glob)), F.lit(None).cast("string") if r.extractor in EXTRACTORS else F.lit(r.extractor)).otherwise(out)
    for g in policy.exclude:
        out = F.when(p.rlike(regex_of(g)), F.lit(None).cast("string")).otherwise(out)
    return out


def watched_dir(path: str, policy: Policy) -> bool:
    """False if an exclude covers the folder or all that can lie below it."""
    return not any(glob_match(g, path) or all(glob_match(g, f"{path}/{x}") for x in ("\x01", "\x01/\x01")) for g in policy.exclude)
