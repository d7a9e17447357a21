"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass turns every whole text into ``FEATURES`` (transformed so that they are
roughly normal) and stores them; labelled rows then give class means and
covariances as sums that Spark adds up, so no row is sampled.  Covariances are
shrunk towards the pooled one and towards a sphere.  Scores are logistic in the
difference of log-densities, with Mahalanobis distances solved against cached
Cholesky factors.

Defined cases: a null or empty text has the statistics of no words and gets a
score like any other; rows without a label are scored and not learnt from;
several labels of one document count as their maximum; without labels of both
classes the score is the prior (0.5 with none at all).  Only ``doc_id`` and
``text`` of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import LOWER, NOT_SPACE, Chunk, byte_table, chunks, combine, per_document, rolling_prefix, span_hash, written

FEATURES = (
    "log_words", "mean_word", "sd_word", "symbols", "capitals", "digits", "stops", "accents",
    "log_repeat_word", "log_repeat_pair", "log_repeat_line", "log_line", "top_word", "odd_ends",
)
#: share of the pooled covariance, and of the sphere, in each class covariance
SHRINK_POOLED, SHRINK_SPHERE = 0.2, 0.02
_SYMBOL = byte_table("#*$%&|<>@^~=+_/\\{}[]")
_CAPITAL = byte_table((0x41, 0x5A))
_DIGIT = byte_table((0x30, 0x39))
_STOP = byte_table(".,;:!?")
_HIGH = byte_table((0x80, 0xFF))
_PLAIN_END = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), ".,;:?)'\"")


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, with half a count added so that none and all stay finite."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of ``FEATURES`` for each document of the chunk."""
    data, off = chunk.data, chunk.off
    starts, ends, at = chunk.words(NOT_SPACE)
    n_bytes = np.diff(off)
    n = np.diff(at)
    some = np.maximum(n, 1)
    length = (ends - starts).astype(np.float64)
    sums = np.concatenate(([0], np.cumsum(length)))
    squares = np.concatenate(([0], np.cumsum(length * length)))
    mean = (sums[at[1:]] - sums[at[:-1]]) / some
    spread = np.sqrt(np.maximum((squares[at[1:]] - squares[at[:-1]]) / some - mean * mean, 0))
    count = lambda table: per_document(table[data], off)
    in_words = per_document(length.astype(np.int64), at)
    low = LOWER[data]
    prefix = rolling_prefix(low)
    words = span_hash(prefix, starts, ends, low)
    pairs = combine([words[:-1], words[1:]]) if len(words) > 1 else words[:0]
    newline = np.flatnonzero(data == 0x0A)
    line_at = np.searchsorted(newline, off)
    distinct_words, distinct_pairs, distinct_lines, lines, top = (np.ones(len(n)) for _ in range(5))
    for d in np.flatnonzero(n):
        a, b = at[d], at[d + 1]
        own = np.sort(words[a:b])
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        distinct_words[d] = len(first)
        top[d] = np.diff(np.append(first, len(own))).max()
        if b - a > 1:
            distinct_pairs[d] = len(np.unique(pairs[a : b - 1]))
        breaks = newline[line_at[d] : line_at[d + 1]]
        begin = np.concatenate(([off[d]], breaks + 1))
        until = np.concatenate((breaks, [off[d + 1]]))
        full = until > begin
        lines[d] = max(1, full.sum())
        distinct_lines[d] = max(1, len(np.unique(span_hash(prefix, begin[full], until[full], low))))
    odd = per_document(~_PLAIN_END[data[ends - 1]], at) if len(ends) else np.zeros(len(n))
    return np.column_stack(
        [
            np.log1p(n), mean, np.log1p(spread), _logit(count(_SYMBOL), in_words), _logit(count(_CAPITAL), in_words), _logit(count(_DIGIT), in_words),
            _logit(count(_STOP), in_words), _logit(count(_HIGH), in_words), np.log(some / distinct_words), np.log(np.maximum(n - 1, 1) / distinct_pairs),
            np.log(lines / distinct_lines), np.log1p(n_bytes / lines), _logit(top - 1, some), _logit(odd, n),
        ]
    )


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``x array<double>`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                x = statistics(chunk)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), flat], ["doc_id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a lower triangular system by forward substitution."""
    out = np.empty_like(b)
    for k in range(len(factor)):
        out[k] = (b[k] - factor[k, :k] @ out[:k]) / factor[k, k]
    return out


@dataclass
class Discriminant:
    """Means and Cholesky factors of both classes; ``factors`` is None where a class is missing."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bias = np.log(self.prior / (1 - self.prior))
        if self.factors is None:
            return np.full(len(x), bias)
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = _forward(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return density[1] - density[0] + bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fits rows of ``x array<double>, label int`` (0 or 1): sums only, whatever their number."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d)
            x = np.column_stack([x, np.ones(len(x))])
            label = np.asarray(batch.column("label"))
            for k in (0, 1):
                total[k] += x[label == k].T @ x[label == k]
        k, i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["k", "i", "j", "s"])

    rows = labelled.select("x", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    total = np.zeros((2, d + 1, d + 1))
    for r in rows.mapInArrow(sums, "k long, i long, j long, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.k, r.i, r.j] = r.s
    count = total[:, d, d]
    prior = (count[1] + 1) / (count.sum() + 2)
    if count.min() < 2:
        return Discriminant(prior)
    means = total[:, :d, d] / count[:, None]
    scatter = np.array([total[k, :d, :d] - count[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(axis=0) / count.sum()
    sphere = np.diag(np.maximum(np.diag(pooled), 1e-3))
    shrunk = [(1 - SHRINK_POOLED - SHRINK_SPHERE) * scatter[k] / count[k] + SHRINK_POOLED * pooled + SHRINK_SPHERE * sphere for k in (0, 1)]
    return Discriminant(prior, means, np.linalg.cholesky(np.array(shrunk)))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` of feature rows.  The model is a few kB and goes with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, is ``fold`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = written(spark, features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-features")
    labels = labels_of(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality").where(~held_out(F.col("doc_id"), 3, 1))
    model = fit(x.join(labels, "doc_id").select("x", "label"))
    scored = score(x, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
