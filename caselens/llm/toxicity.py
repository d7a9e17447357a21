"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct lower-cased words, word pairs and one-word skip pairs
of a text, hashed into ``2**BITS`` coordinates.  Each coordinate has its own
learning rate, and the L1 term keeps most weights at exactly zero, so the
weights that are broadcast are few and can't exceed ``2**BITS``.

FTRL is sequential, so it learns in one task, from a bounded sample: the
``TRAIN_ROWS`` labelled rows with the smallest hash of their id.  Everything
else covers all rows.

Defined cases: a null or empty text has no features and is scored by the bias;
several labels of one document count as their maximum; of several texts of one
id the one with the least hash is learnt from; without labels every score is
0.5, and ids of any type do.  Only ``doc_id`` and ``text`` of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_qda import held_out, labels_of
from .textcore import ALNUM, LOWER, Chunk, chunks, combine, rolling_prefix, span_hash

BITS = 20
#: labelled rows that FTRL learns from, at most
TRAIN_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0


def hashed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Document (by its number in the chunk) and coordinate of every feature, repeats included."""
    low = LOWER[chunk.data]
    starts, ends, at = Chunk(low, chunk.off, chunk.first).words(ALNUM)
    words = span_hash(rolling_prefix(low), starts, ends, low)
    of = np.repeat(np.arange(len(chunk)), np.diff(at))
    docs, values = [of], [words]
    for gap in (1, 2):
        if len(words) > gap:
            same = of[gap:] == of[:-gap]
            docs.append(of[gap:][same])
            values.append(combine([words[:-gap][same], words[gap:][same]], seed=gap))
    return np.concatenate(docs), (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int32)


def _per_document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            of, at = hashed(chunk)
            key = np.unique(of.astype(np.int64) << BITS | at)
            counts = np.bincount(key >> BITS, minlength=len(chunk))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
            rest = [batch.column(n).slice(chunk.first, len(chunk)) for n in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*rest, lists], ["doc_id", "label", "at"])


@dataclass
class Weights:
    """Non-zero weights only."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def learn(examples: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL-proximal over examples (coordinates, label) in the given order, ``EPOCHS`` times."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in examples:
            at = np.append(at, bias)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            root = np.sqrt(ni)
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    at = np.flatnonzero(w[:bias])
    return Weights(at.astype(np.int32), w[at].astype(np.float32), float(w[bias]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    """Learns from at most ``rows`` rows of ``labels`` (doc_id, label), in one task, in hash order of their ids."""
    order = F.xxhash64(F.col("doc_id"))
    sample = labels.select("doc_id", "label").orderBy(order, "doc_id").limit(rows)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``rows`` ids

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            at, label = batch.column("at"), batch.column("label").to_pylist()
            flat, off = np.asarray(at.flatten()), np.asarray(at.offsets)
            off = off - off[0]
            examples += [(flat[off[i] : off[i + 1]], label[i]) for i in range(batch.num_rows)]
        w = learn(examples)
        yield pa.RecordBatch.from_arrays([pa.array([w.at], pa.list_(pa.int32())), pa.array([w.weight], pa.list_(pa.float32())), pa.array([w.bias])], ["at", "weight", "bias"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # of the texts of a repeated id, the one of the least hash; so no more than ``rows`` rows meet in the task
    chosen = chosen.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("of")).select("doc_id", "of.*")
    found = chosen.mapInArrow(_per_document_features, f"doc_id {kind}, label int, at array<int>")
    one = found.repartition(1).sortWithinPartitions(order, "doc_id")
    row = one.mapInArrow(train, "at array<int>, weight array<float>, bias double").first()
    if row is None:  # nothing to learn from
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return Weights(np.array(row.at, np.int32), np.array(row.weight, np.float32), row.bias)


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.at, weights.weight, weights.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights(*shared.value)
        dense = w.dense()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                of, at = hashed(chunk)
                keep = dense[at] != 0
                key = np.unique(of[keep].astype(np.int64) << BITS | at[keep])
                total = w.bias + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], len(chunk))
                result = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(result)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = labels_of(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score(docs, fit(docs, labels.select("doc_id", F.col("label").cast("int").alias("label"))))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
