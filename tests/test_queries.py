"""Each registered query against its SQL."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from skeinix.plans import queries as plans  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got
    if name in plans.SQL:
        rel = con.sql(plans.SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def brute_chunks(text, most=500):
    """Blocks up to a blank line; of those that are too long their lines, cut; packed in order."""
    blocks = [""]
    for line in text.splitlines(keepends=True):
        blank = blocks[-1] and not line.strip()
        blocks[-1] += line
        if blank and line.endswith("\n"):
            blocks.append("")
    units = [u for b in blocks if b for u in ([b] if len(b) <= most else [x[i : i + most] for x in b.splitlines(keepends=True) for i in range(0, len(x), most)])]
    out = []
    for u in units:
        if out and len(out[-1]) + len(u) <= most:
            out[-1] += u
        else:
            out.append(u)
    return out


def test_plain_chunks_of_all_documents(spark, tmp_path):
    import hashlib

    rows = [(0, None), (1, ""), (2, "x" * 1234), (3, "a line\n" * 200), (4, "one\ntwo\n\n" + "w " * 400 + "\nend\n\nlast"), (5, "short\nlines"), (6, ("p" * 300 + "\n\n") * 3 + "é" * 700 + "\n" + "q" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["chunk_plain"](spark, str(tmp_path)).collect())
    assert got == [(i, k, hashlib.md5(c.encode()).hexdigest()) for i, t in rows for k, c in enumerate(brute_chunks(t or ""))]
    assert {r[0] for r in got} == {2, 3, 4, 5, 6}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
