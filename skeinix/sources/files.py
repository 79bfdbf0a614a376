"""Folders of files as tables: scan, classify, extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk import ChunkConfig, chunks
from ..functions.glob import Policy, classify
from ..functions.strings import chunk_strategy_id, extract_key

TEXT_MAX, IMAGE_MAX, EXTRACTOR_VERSION = 8 << 20, 20 << 20, "1"


def relative(path, root: str):
    """The path below root, of a file: url or plain path."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return F.substring(plain, len("/" + root.split("://")[-1].strip("/")) + 2, 1 << 20)


def scan(spark: SparkSession, root: str, policy: Policy = Policy(), content: bool = True) -> DataFrame:
    """(root, path, length, modified, extractor, skip, content): a row a file. Skipped files keep their reason and lose their content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    d = raw.select(F.lit(root).alias("root"), relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    c = classify(F.col("path"), policy)
    d = d.withColumn("extractor", c["extractor"]).withColumn("skip", c["skip"])
    big = (F.col("extractor") == "text") & (F.col("length") > TEXT_MAX) | (F.col("extractor") == "image") & (F.col("length") > IMAGE_MAX)
    d = d.withColumn("skip", F.when(big, "too_large").otherwise(F.col("skip")))
    if content:
        broken = (F.col("extractor") == "text") & F.col("skip").isNull() & ~F.is_valid_utf8(F.col("content").cast("string"))
        d = d.withColumn("skip", F.when(broken, "invalid_utf8").otherwise(F.col("skip")))
        d = d.withColumn("content", F.when(F.col("skip").isNull(), F.col("content")))
    return d.withColumn("extractor", F.when(F.col("skip").isNull(), F.col("extractor")))


def keyed(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Files with content_sha256 and extract_key, which names what extraction would give."""
    plain = F.lower(F.col("path")).rlike(r"\.html?$")
    ids = {s: chunk_strategy_id(s, policy.max_chars, policy.overlap_chars, policy.min_chars, EXTRACTOR_VERSION) for s in (policy.split, "plain")}
    strategy = F.when(plain, ids["plain"]).otherwise(ids[policy.split])
    sha = F.sha2(F.col("content"), 256)
    return files.where("skip is null").withColumn("content_sha256", sha).withColumn("extract_key", extract_key(sha, F.col("extractor"), F.lit(EXTRACTOR_VERSION), strategy))


def extract(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(extract_key, text, headings, start_byte, end_byte, chunk_index, modality): chunks of texts; of an image its name."""
    cfg = ChunkConfig(policy.split, policy.max_chars, policy.overlap_chars, policy.min_chars)
    texts = files.where("extractor = 'text'").select("extract_key", F.col("content").cast("string").alias("text"), F.lower(F.col("path")).rlike(r"\.html?$").alias("plain"))
    t = chunks(texts, cfg, keep=("extract_key",), plain="plain").withColumn("modality", F.lit("text"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    i = files.where("extractor = 'image'").select("extract_key", stem.alias("text"), F.array().cast("array<string>").alias("headings"), F.lit(0).cast("long").alias("start_byte"), F.col("length").alias("end_byte"), F.lit(0).alias("chunk_index"), F.lit("image").alias("modality"))
    return t.unionByName(i)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) of each folder directly below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = relative(F.col("path"), path)
    return raw.select(F.when(F.locate("/", rel) > 0, F.substring_index(rel, "/", 1)).otherwise(".").alias("folder"), "length").groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
