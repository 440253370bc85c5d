"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - f(x)) with one weight vector for all grades
and thresholds theta_0 < theta_1 < ...  (kept in order as a first threshold and
positive steps).  f sums the weights of the distinct features of a text: its
words (ASCII letters and digits and all other non-ASCII; A-Z lower-cased) and
the shapes of its raw words (classes of the first and the last two characters),
hashed to ``BUCKETS``.

The model is fitted on a sample of at most ``SAMPLE`` rated documents, those
whose ids have the smallest hashes, by AdaGrad over fixed mini-batches on the
driver; features that fewer than ``MIN_DOCS`` of them hold get no weight.  The
weights (BUCKETS doubles, 2 MB) go to every task, which scores whole texts.

Defined results: a null or empty text has no features and scores f = 0.  Rows of
the ratings with a null id or grade are left out; of several grades of an id the
lowest holds.  Without ratings every grade is equally likely.  A null doc_id
stays null, repeated rows are scored each.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import _LOWER, Slice, slices
from .common import small_batches, table

BUCKETS = 1 << 18
SAMPLE = 20_000
MIN_DOCS = 5
EPOCHS = 6
BATCH = 128
RATE = 0.1
L2 = 1e-4

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a slice, by row."""
    starts, ends, first = s.words()
    back = np.maximum(ends - 2, starts)
    shape = (_CLASS[s.buf[starts]] << 16) | (_CLASS[s.buf[back]] << 8) | _CLASS[s.buf[ends - 1]]
    shape = (shape * 0x9E3779B1 >> 7) % BUCKETS
    raw = s.buf
    s.buf = _LOWER[raw]
    w0, w1, word_first = s.segments(_NOT_WORD)
    word = (s.hashes(w0, w1) % np.uint64(BUCKETS)).astype(np.int64)
    s.buf = raw
    row = np.concatenate([np.repeat(np.arange(s.n), np.diff(first)), np.repeat(np.arange(s.n), np.diff(word_first))])
    pair = np.unique(row * BUCKETS + np.concatenate([shape, word]))
    return pair // BUCKETS, pair % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (rows, grades - 1)."""
        return 1 - _sigmoid(self.thresholds[None, :] - f[:, None])


def _sampled(docs: DataFrame, ratings: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades, and the features of the sampled rows as flat buckets and edges."""
    rated = (ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches):
        for s in slices(batches):
            row, bucket = features(s)
            edge = np.searchsorted(row, np.arange(s.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), s.column("grade").cast(pa.int32()),
                 pa.ListArray.from_arrays(edge, pa.array(bucket.astype(np.int32)))], ["doc_id", "grade", "buckets"])

    rows = (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(rated), "doc_id")    # at most ``sample`` rows
            .mapInArrow(run, "doc_id long, grade int, buckets array<int>").toArrow())
    order = np.argsort((np.asarray(rows.column("doc_id")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    rows = rows.take(pa.array(order)).combine_chunks()
    lists = rows.column("buckets").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))]) if rows.num_rows else np.zeros(1, np.int64)
    return np.asarray(rows.column("grade")).astype(np.int64), np.asarray(lists.flatten()).astype(np.int64), edge


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, min_docs: int = MIN_DOCS,
        epochs: int = EPOCHS) -> Model:
    """Fit on ``ratings`` (doc_id, grade in 0 .. grades - 1)."""
    y, bucket, edge = _sampled(docs, ratings, sample)
    known = np.bincount(bucket, minlength=BUCKETS) >= min_docs
    w, w2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    share = np.clip((np.cumsum(np.bincount(y, minlength=grades)) + 0.5) / (len(y) + 1), 0.02, 0.98)[:-1] \
        if len(y) else np.arange(1, grades) / grades
    cut = np.log(share / (1 - share))
    first, steps = cut[:1].copy(), np.log(np.maximum(np.diff(cut), 1e-3))
    t2 = np.full(grades - 1, 1e-8)
    for _ in range(epochs):
        for a in range(0, len(y), BATCH):
            b = min(a + BATCH, len(y))
            at = np.arange(edge[a], edge[b])
            row = np.repeat(np.arange(b - a), np.diff(edge[a:b + 1]))
            own = bucket[at]
            use = known[own]
            own, row = own[use], row[use]
            f = np.bincount(row, w[own], b - a)
            theta = np.concatenate([[-np.inf], first[0] + np.concatenate([[0], np.cumsum(np.exp(steps))]), [np.inf]])
            hi, lo = _sigmoid(theta[y[a:b] + 1] - f), _sigmoid(theta[y[a:b]] - f)
            p = np.maximum(hi - lo, 1e-9)
            slope = (1 - hi - lo) / (b - a)
            unique, inverse = np.unique(own, return_inverse=True)
            g = np.bincount(inverse, slope[row], len(unique)) + L2 * w[unique]
            w2[unique] += g * g
            w[unique] -= RATE * g / np.sqrt(w2[unique])
            gt = np.zeros(grades + 1)
            np.add.at(gt, y[a:b] + 1, -hi * (1 - hi) / p / (b - a))
            np.add.at(gt, y[a:b], lo * (1 - lo) / p / (b - a))
            gt = gt[1:-1]
            own_gradient = np.concatenate([[gt.sum()], np.exp(steps) * np.cumsum(gt[::-1])[::-1][1:]])
            t2 += own_gradient ** 2
            move = RATE * own_gradient / np.sqrt(t2)
            first, steps = first - move[:1], np.clip(steps - move[1:], -7, 4)
    return Model(w, first[0] + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability (of the top
    grade), selected (tail_probability >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for s in slices(batches):
            row, bucket = features(s)
            tails = m.tails(np.bincount(row, m.weights[bucket], s.n))
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").cast(pa.int64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]),
                 pa.array(tails[:, -1] >= threshold)], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, graded(table(spark, sf_dir, "labels")), 3))
