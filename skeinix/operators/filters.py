"""Typed pre-filters: equality, membership and ranges on scalar fields, all of which must hold.

Comparison is strict: an int never matches a float field's value and so on; a
missing value matches nothing.  Predicates are plain column expressions, so they
reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError

_PY = {"int": int, "float": float, "bool": bool, "keyword": str}


def _fits(kind: str, v) -> bool:
    if kind == "int":
        return isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63
    return type(v) is _PY[kind]


def _equal(c: Column, kind: str, v) -> Column:
    if not _fits(kind, v) or (kind == "float" and v != v):
        return F.lit(False)
    return c == F.lit(v)


def condition(name: str, kind: str, op: str, v) -> Column:
    c = F.col(name)
    if op == "eq":
        return _equal(c, kind, v)
    if op == "in":
        if not isinstance(v, (list, tuple, set)):
            raise EngineError("INVALID_ARG", f"{name}: 'in' needs a list")
        fit = [x for x in v if _fits(kind, x) and x == x]
        return c.isin(fit) if fit else F.lit(False)
    if op == "gte":
        return c >= F.lit(v) if _fits(kind, v) else F.lit(False)
    if op == "lte":
        return c <= F.lit(v) if _fits(kind, v) else F.lit(False)
    raise EngineError("INVALID_ARG", f"unknown condition {op}")


def predicate(spec: dict | None, kinds: dict[str, str]) -> Column | None:
    """One column from {field: value | {op: value}}; None for no filter."""
    parts = []
    for name, conds in (spec or {}).items():
        if name not in kinds:
            raise EngineError("INVALID_ARG", f"{name} isn't a scalar field")
        for op, v in (conds if isinstance(conds, dict) else {"eq": conds}).items():
            parts.append(condition(name, kinds[name], op, v))
    return reduce(Column.__and__, parts) if parts else None


def alive(docs, tombstones, key: str = "docid"):
    """docs without the deleted ones."""
    return docs if tombstones is None else docs.join(tombstones.select(key).distinct(), key, "left_anti")
