"""Operator 3: BPE encoding and decoding of a text column, by prefix-sharing trie traversal.

No shuffle: a worker encodes each distinct word that it meets once (see ``bpe``)
and puts the documents together from those.  Null texts count as empty ones;
texts of any length are taken whole; repeated rows give repeated rows; an empty table
gives no rows; other columns pass through ``encode``/``decode`` untouched, even when they have the
names used here for inner purposes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load, tokenizer_path
from .common import slices, table


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", to: str = "token_ids", path: str | None = None) -> DataFrame:
    """df and the token ids of its column ``text`` (array of int; empty for null or empty text)."""
    path, at = path or tokenizer_path("byte_bpe_50k.json"), df.columns.index(text)

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            ids = bpe.encode_batch(b.column(at).to_pylist())
            ends = np.cumsum([len(x) for x in ids])
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, to])

    return df.mapInArrow(run, _with(df, to, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "token_ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """df and the text of its column ``ids`` (null: null)."""
    path, at = path or tokenizer_path("byte_bpe_50k.json"), df.columns.index(ids)

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            out = [None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, to])

    return df.mapInArrow(run, _with(df, to, T.StringType()))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: key, n_tokens, and the digests of the ids and of what they decode to."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        bpe = load(path)
        digits = [str(i) for i in range(len(bpe.token_bytes))]
        for b in slices(batches):
            n, first, second = [], [], []
            for ids in bpe.encode_batch(b.column(1).to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
