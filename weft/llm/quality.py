"""Quality scores by positive-unlabelled learning.

A linear model over byte-class pairs and repetition figures of whole texts minimises the
non-negative unbiased risk: trusted positives (label 1 of the training folds), unlabelled
documents, and a class prior estimated from the training folds' labels. The model is fitted on
bounded samples, at most POSITIVES and UNLABELLED rows in order of a hash; everything else,
scores included, covers every row. Null and empty texts are scored as empty. Without a
positive every score is 1. Rows give one row each; a null id is of no fold and not held out.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

POSITIVES, UNLABELLED = 3000, 6000
PUNCT = bytes(x for x in range(33, 127) if not chr(x).isalnum())
CLASS = np.zeros(256, np.int64)  # 0: control bytes
CLASS[[9, 32]], CLASS[[10, 13]] = 1, 2
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 3, 4, 5, 6
CLASS[list(PUNCT)] = np.arange(7, 7 + len(PUNCT))
N = 7 + len(PUNCT)
SIZE = N * N + 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    c = CLASS[np.frombuffer(raw, np.uint8)]
    out = np.zeros(SIZE, np.float32)
    if len(c) > 1:
        out[: N * N] = np.sqrt(np.bincount(c[:-1] * N + c[1:], minlength=N * N) / (len(c) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    out[N * N :] = (
        len(set(words)) / len(words) if words else 0,
        len(set(lines)) / len(lines) if lines else 0,
        min(1.0, len(raw) / len(words) / 20) if words else 0,
        np.log1p(len(words)) / 10,
        not words,
    )
    return out


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the smallest non-negative risk under logistic loss, by Adam."""
    # the samples are held in single precision, once more as x
    x = np.concatenate([pos, unl]).astype(np.float32, copy=False)
    mean = x.mean(0, dtype=np.float64)
    x -= mean.astype(np.float32)
    dev = np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)) + 0.01
    x /= dev.astype(np.float32)
    p, u = x[: len(pos)], x[len(pos) :]
    w = np.zeros(x.shape[1] + 1)
    m, v = w.copy(), w.copy()
    for t in range(1, steps + 1):
        z = (x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1]
        zp, zu = z[: len(pos)], z[len(pos) :]
        # losses of calling z negative: log(1 + e^z); its slope is the sigmoid
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(p), np.zeros(len(u))
        if neg >= 0:
            gp, gu = gp - prior * sp / len(p), su / len(u)
        else:  # step away from a negative risk
            gp, gu = prior * sp / len(p), -su / len(u)
        g = np.r_[gp.astype(np.float32) @ p + gu.astype(np.float32) @ u, gp.sum() + gu.sum()]
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] / dev, float(w[-1] - (w[:-1] * mean / dev).sum())


def _fitted(sample: DataFrame, prior: float) -> tuple[np.ndarray, float]:
    """The model of sample (doc_id, positive, text), fitted in one task, so that the driver holds no sample."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["doc_id", "positive", "x"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {True: [], False: []}
        for b in batches:
            if not b.num_rows:
                continue
            # every value has the same length, so a batch's bytes are its rows
            c, p = b.column(2), b.column(1).to_numpy(zero_copy_only=False)
            x = np.frombuffer(c.buffers()[2], np.float32, (c.offset + len(c)) * SIZE).reshape(-1, SIZE)[c.offset :]
            for k, rows in parts.items():
                rows.append(x[p == k])
        pos, unl = (np.concatenate(rows) if rows else np.empty((0, SIZE), np.float32) for rows in (parts[True], parts[False]))
        if len(pos) and len(unl):
            w, bias = fit(pos, unl, prior)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["w", "bias"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    x = sample.select("doc_id", "positive", "text").mapInArrow(vectors, f"doc_id {kind}, positive boolean, x binary")
    # the order of the rows fixes the last digits
    got = x.repartition(1).sortWithinPartitions("positive", "doc_id").mapInArrow(model, "w binary, bias double").collect()
    return (np.frombuffer(got[0].w), got[0].bias) if got else (np.zeros(SIZE), np.inf)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """The model, from at most `positives` and `unlabelled` documents, one row of each doc_id.

    The prior is the share of label 1 in the training folds, which takes the labelled rows for a
    fair sample of all."""
    lab = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = lab.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    order = F.xxhash64("doc_id")
    there = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct()
    ids = lab.where("quality = 1").select("doc_id").join(there, "doc_id", "left_semi").orderBy(order, "doc_id").limit(positives)
    # a repeated id gives one row, so both samples are bounded by their limits
    sample = lambda ids: docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = lambda ids, positive: sample(ids).select("doc_id", F.lit(positive).alias("positive"), "text")
    if prior is None:
        return np.zeros(SIZE), np.inf
    every = there.where("doc_id is not null").orderBy(order, "doc_id").limit(unlabelled)
    return _fitted(rows(ids, True).unionByName(rows(every, False)), min(prior, 0.99))


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with the score appended as column name; its other columns stay as they are."""
    w, bias = model
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([features(t) @ w for t in b.column(b.schema.get_field_index("text")).to_pylist()]) + bias
            s = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    s = score(docs.select("doc_id", "text"), learn(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, learn(docs, labels), name).where(F.col(name) >= least).drop(name)
