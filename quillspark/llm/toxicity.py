"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade <= j) = sigmoid(threshold_j - w.x): the thresholds are ordered, the
weights w are shared by all of them, and the expected severity is the sum
over j of P(grade > j). Features are words (A-Z lower-cased, ASCII
punctuation taken as space), each with 1 + ln(count).

The labels only tell toxic from not toxic, so the grades are: 0, not toxic;
1, toxic, with up to the median amount of telling words among the toxic; 2,
toxic, with more. Telling words are the selected features that favour toxic
documents, and each amounts to 1 + ln(count).

Training uses at most TRAIN_DOCS labelled documents of either mark, those
first by a hash of their id, with their whole texts. Of their words, the up
to FEATURES with the highest log-likelihood ratio of at least LEAST_RATIO
are features; so what comes to the driver is bounded by TRAIN_DOCS times
FEATURES counts. Scoring sees every document.

Defined cases: a null or empty text has no features and the base severity;
labels that are null, or name no document, are not learned from; a document
with several labels counts each; without a toxic label the severity is 0;
repeated rows are scored each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 4000
FEATURES = 4096
LEAST_RATIO = 12.0
L2 = 1e-4
STEPS = 600


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of every row's distinct words."""
    raw, offsets = common.text_buffers(column)
    h, n = common.word_hashes(raw, offsets, common.PUNCTUATION)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights by word hash (sorted) and ordered thresholds."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return sigmoid(eta[:, None] - self.thresholds[None, :])

    def eta(self, row: np.ndarray, word: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.words):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        return np.bincount(row[hit], self.weights[at[hit]] * (1 + np.log(count[hit])), rows)


def fitted(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam over the penalised log-likelihood."""
    rows, top = len(grade), int(grade.max())
    w, start, gaps = np.zeros(width), np.array([1.0]), np.zeros(max(0, top - 1))
    params = [w, start, gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        theta = np.concatenate([start, start + np.cumsum(np.exp(gaps))])
        eta = np.bincount(row, w[feature] * value, rows)
        # P(grade <= j) for j = -1 .. top
        cdf = np.concatenate([np.zeros((rows, 1)), sigmoid(theta[None, :] - eta[:, None]), np.ones((rows, 1))], axis=1)
        hi, lo = cdf[np.arange(rows), grade + 1], cdf[np.arange(rows), grade]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_eta = (dhi - dlo) / rows  # of the negative log-likelihood
        d_theta = np.zeros(top)
        for j in range(top):
            d_theta[j] = (dlo[grade == j + 1].sum() - dhi[grade == j].sum()) / rows
        grads = [np.bincount(feature, d_eta[row] * value, width) + L2 * w, np.array([d_theta.sum()]), np.array([d_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(top - 1)])]
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w, np.concatenate([start, start + np.cumsum(np.exp(gaps))])


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic") -> OrdinalModel:
    spark = docs.sparkSession
    common.bounded_batches(spark)
    marks = labels.where(f"`{key}` IS NOT NULL AND `{mark}` IN (0, 1)").select(F.col(key).alias("k"), F.col(mark).cast("int").alias("y"))
    chosen = common.first_rows(marks, "y", [F.xxhash64(F.lit(11), "k"), F.col("k")], TRAIN_DOCS).select("k", "y")
    # at most TRAIN_DOCS ids for each of the two marks
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, word, count = _counts(b.column(2))
            at = pa.array(row)
            yield common.from_columns(["k", "y", "word", "n"], [b.column(0).take(at).cast(pa.int64()), b.column(1).take(at), pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))])

    slim = rows.withColumn("k", F.xxhash64("k"))
    found = common.written(slim.mapInArrow(counted, "k long, y int, word long, n long"), "counts")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return OrdinalModel()
    by = found.groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))

    def term(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    n = F.col("a") + F.col("b")
    ea, eb = n * pos / (pos + neg), n * neg / (pos + neg)
    ca, cb = F.lit(float(pos)) - F.col("a"), F.lit(float(neg)) - F.col("b")
    rest = F.lit(float(pos + neg)) - n
    ratio = 2 * (term(F.col("a"), ea) + term(F.col("b"), eb) + term(ca, rest * pos / (pos + neg)) + term(cb, rest * neg / (pos + neg)))
    best = by.withColumn("g", ratio).where(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "word").limit(FEATURES).select("word", (F.col("a") / pos > F.col("b") / neg).alias("tells"))
    best = common.written(best, "words")
    chosen_words = best.toPandas()
    hits = found.join(F.broadcast(best), "word").select("k", "y", "word", "n", "tells").toPandas()
    everyone = slim.select("k", "y").toPandas().drop_duplicates().reset_index(drop=True)
    words = np.sort(chosen_words["word"].to_numpy(np.int64).view(np.uint64))
    if not len(words):
        return OrdinalModel()
    index = {tuple(x): i for i, x in enumerate(everyone[["k", "y"]].itertuples(index=False))}
    row = np.array([index[k, y] for k, y in zip(hits["k"], hits["y"], strict=True)], np.int64)
    amount = np.bincount(row, np.where(hits["tells"], 1 + np.log(hits["n"].to_numpy(float)), 0.0), len(everyone))
    toxic = everyone["y"].to_numpy() == 1
    grade = np.where(toxic, np.where(amount > np.median(amount[toxic]), 2, 1), 0)
    value = 1 + np.log(hits["n"].to_numpy(float))
    w, theta = fitted(row, np.searchsorted(words, hits["word"].to_numpy(np.int64).view(np.uint64)), value, grade, len(words))
    return OrdinalModel(words, w, theta)


def scored(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, p_toxic, grade, toxic) of every row."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = np.zeros(1 << 16, bool)
        seen[model.words >> np.uint64(48)] = True
        for b in batches:
            raw, offsets = common.text_buffers(b.column(1))
            h, n = common.word_hashes(raw, offsets, common.PUNCTUATION)
            at = np.flatnonzero(seen[h >> np.uint64(48)])
            row, word = np.repeat(np.arange(len(n)), n)[at], h[at]
            pair, count = np.unique(np.stack([row.astype(np.uint64), word]), axis=1, return_counts=True) if len(at) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            above = model.above(model.eta(pair[0].astype(np.int64), pair[1], count, len(n)))
            p = above[:, 0] if above.shape[1] else np.zeros(len(n))
            grade = (above >= 0.5).sum(1).astype(np.int32)
            yield common.from_columns([key, "severity", "p_toxic", "grade", "toxic"], [b.column(0), pa.array(above.sum(1)), pa.array(p), pa.array(grade), pa.array(grade > 0)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(rows, f"`{key}` {kind}, severity double, p_toxic double, grade int, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, learned(docs, common.table(spark, sf_dir, "labels")))
