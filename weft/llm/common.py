"""Helpers of this subpackage: written tables that cut lineage, hashed shingles, components.

Written tables lie below the session's `spark.checkpoint.dir`. Where that is unset, a local
session gets a folder made for the process; a cluster session gets an error, as its executors
would each write to a disk of their own.
"""
import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

M64 = (1 << 64) - 1
MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CHARS = 2_000_000  # characters of text in a slice; a longer text is a slice of its own


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, held: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again; held gets the table's path. codec is the table's compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    cleans = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # no later job reads the shuffle files of this one
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, cleans)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, held: list[str]) -> None:
    """Deletes the tables of held, which nothing reads any more."""
    for path in held:
        drop(spark, path)
    held.clear()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of batch and their texts in `column`, each of about BATCH_CHARS characters."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 64
        if size >= BATCH_CHARS:
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, kept for those seen last."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        k = self.known
        if len(k) > self.most:
            k.clear()
        for w in set(words):
            if w not in k:
                k[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(k.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words in order; of fewer words, of the whole sequence."""
    if len(h) == 0:
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * MIX1 + h[i : len(h) - width + 1 + i])
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8, A-Z lowered."""
    return (text or "").encode().lower().split()


def components(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, label) of every id in edges (a, b): label is the smallest id reachable.

    Alternating large and small stars, each round written out, until only stars are left: no id
    has two smaller neighbours, or both a smaller and a larger one. A round joins each edge to one
    minimum a node, so hubs are for adaptive skew joins to split. keep gets the path of the table
    that the result reads.
    """
    spark, held = edges.sparkSession, []
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), held)
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        old, held = held, []
        e = cut(small.distinct(), held)
        clear(spark, old)
    if keep is not None:
        keep += held
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
