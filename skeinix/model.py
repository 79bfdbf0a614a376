"""Schemas, queries, limits and errors of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DIM_MAX, TOPK_MAX, SEGMENT_MAX = 4096, 1000, 10
K1, B, RRF_K = 1.2, 0.75, 60
MULTIPLIER, TOP_K = 3, 10
PROJECT_TOP_K, PROJECT_TOP_K_MAX, SNIPPET = 8, 50, 240
COMMIT_MS, COMMIT_DOCS = 1000, 1000
DICT_MAX = 100_000

CODES = {"IO": -1, "SCHEMA": -2, "NOT_FOUND": -3, "CORRUPT": -4, "VERSION": -5, "TOKENIZER_MISMATCH": -6, "DICT_TOO_LARGE": -7, "DICT_UNAVAILABLE": -8, "BUSY": -9, "UNSUPPORTED": -10, "INVALID_ARG": -11}


class EngineError(Exception):
    """An error with a stable name and code (see CODES)."""

    def __init__(self, name: str, message: str, **context):
        super().__init__(f"{name}: {message}")
        self.name, self.code, self.context = name, CODES[name], context


SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "keyword": T.StringType()}
METRICS = ("cosine", "l2", "dot")


@dataclass(frozen=True)
class Schema:
    """One vector field, a text, and typed scalar fields (name: int, float, bool or keyword)."""

    dim: int
    metric: str = "cosine"
    scalars: tuple[tuple[str, str], ...] = ()
    text: bool = True

    def __post_init__(self):
        if not 0 < self.dim <= DIM_MAX:
            raise EngineError("SCHEMA", f"dim must lie in 1..{DIM_MAX}")
        if self.metric not in METRICS:
            raise EngineError("SCHEMA", f"unknown metric {self.metric}")
        names = [n for n, _ in self.scalars]
        if len(set(names)) != len(names) or set(names) & {"id", "text", "vector", "docid", "dl"}:
            raise EngineError("SCHEMA", "field names clash")
        if bad := [k for _, k in self.scalars if k not in SCALARS]:
            raise EngineError("SCHEMA", f"unknown kind {bad[0]}")

    def kinds(self) -> dict[str, str]:
        return dict(self.scalars)

    def struct(self) -> T.StructType:
        base = [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
        return T.StructType(base + [T.StructField(n, SCALARS[k]) for n, k in self.scalars])

    def to_dict(self) -> dict:
        return {"dim": self.dim, "metric": self.metric, "scalars": [list(s) for s in self.scalars], "text": self.text}

    @classmethod
    def from_dict(cls, d: dict) -> Schema:
        return cls(d["dim"], d["metric"], tuple(tuple(s) for s in d["scalars"]), d.get("text", True))


@dataclass(frozen=True)
class SearchQuery:
    """What to search for. mode: auto, hybrid, vector or text; fusion: rrf or linear.

    filter: {field: {"eq": v, "in": [...], "gte": v, "lte": v}}; a bare value is an eq.
    """

    text: str | None = None
    vector: tuple[float, ...] | None = None
    top_k: int = TOP_K
    mode: str = "auto"
    fusion: str = "rrf"
    alpha: float = 0.5
    multiplier: int = MULTIPLIER
    filter: dict = field(default_factory=dict)

    def resolved_mode(self) -> str:
        if self.top_k > TOPK_MAX or self.top_k < 0:
            raise EngineError("INVALID_ARG", f"topK must lie in 0..{TOPK_MAX}")
        if self.mode not in ("auto", "hybrid", "vector", "text"):
            raise EngineError("INVALID_ARG", f"unknown mode {self.mode}")
        if self.fusion not in ("rrf", "linear"):
            raise EngineError("INVALID_ARG", f"unknown fusion {self.fusion}")
        if self.mode != "auto":
            return self.mode
        if self.text is not None and self.vector is not None:
            return "hybrid"
        if self.text is not None:
            return "text"
        if self.vector is not None:
            return "vector"
        raise EngineError("INVALID_ARG", "a query needs a text or a vector")

    @classmethod
    def from_dict(cls, d: dict) -> SearchQuery:
        """From a JSON object: text, vector, topK, mode, fusion ('rrf' or {'linear': {'alpha': a}}), candidateMultiplier, filter."""
        fusion, alpha = d.get("fusion", "rrf"), 0.5
        if isinstance(fusion, dict):
            if "linear" not in fusion and fusion.get("type") != "linear":
                raise EngineError("INVALID_ARG", "unknown fusion")
            inner = fusion.get("linear") or fusion
            alpha, fusion = float(inner.get("alpha", 0.5)), "linear"
        v = d.get("vector")
        return cls(d.get("text"), None if v is None else tuple(float(x) for x in v), int(d.get("topK", TOP_K)), d.get("mode", "auto"), fusion, alpha, int(d.get("candidateMultiplier", MULTIPLIER)), d.get("filter") or {})
