"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is cut into word tokens and punctuation runs, case kept. Every unigram and bigram is hashed into ``2**BITS``
buckets (a bigram of equal words is hashed as a back-reference, whatever the word); a text's features are the shares of its n-grams in each bucket. FTRL-proximal (McMahan et al. 2013) learns a
sparse weight vector from a bounded sample of labelled rows in a fixed order, so reruns agree. Scoring is one gather
and one segmented sum per n-gram order over a whole slice of texts: a sparse dot product.

Defined results: null and empty texts have no n-gram and score the bias alone; repeated rows score alike; an
empty table gives an empty table; without any usable label the model scores 0.5 everywhere; extra columns pass through
(an input column with an output's name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.hashing import _CLASS, U, mix, prefix_hash, range_hash, sum_by_row, tokens
from glosspark.llm.samples import labelled_texts

BITS = 18
SCALE = 10.0


@dataclass
class FtrlModel:
    weights: np.ndarray  # float32, 2**BITS
    bias: float


def ngram_features(offsets: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2: the bucket of every word n-gram and the row that it stands in."""
    start, end, row = tokens(offsets, data, _CLASS)
    h = mix(range_hash(prefix_hash(data), start, end))
    shift = U(64 - BITS)
    pair = mix(h[:-1] * U(0xC2B2AE3D27D4EB4F) + h[1:]) if len(h) else h
    if len(h):
        pair[h[:-1] == h[1:]] = U(0)  # one bucket for any word said twice running, so that stuttering generalises
    same = row[:-1] == row[1:]
    return [((h >> shift).astype(np.int64), row), ((pair[same] >> shift).astype(np.int64), row[:-1][same])]


def row_features(offsets: np.ndarray, data: np.ndarray) -> dict:
    """Each row's distinct buckets and feature values, packed as bytes (uint32, float32)."""
    n = len(offsets) - 1
    grams = ngram_features(offsets, data)
    key, value = [], []
    for idx, row in grams:
        total = np.bincount(row, minlength=n)
        k, c = np.unique((row << BITS) | idx, return_counts=True)
        key.append(k)
        value.append(SCALE * c / total[k >> BITS])
    key, value = np.concatenate(key), np.concatenate(value)
    k, inverse = np.unique(key, return_inverse=True)
    v = np.bincount(inverse, value, len(k)).astype(np.float32)
    cut = np.searchsorted(k >> BITS, np.arange(n + 1))
    low = (k & ((1 << BITS) - 1)).astype(np.uint32)
    return {"idx": pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), "val": pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())}


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> FtrlModel:
    """FTRL-proximal over (buckets, values, label) in the given order; the bias is one more, unpenalised coordinate."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    size = 1 << BITS

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        cut = np.where(i == size, 0.0, l1)
        return np.where(np.abs(zi) <= cut, 0.0, -(zi - np.sign(zi) * cut) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:  # widened one at a time: all at once are three times as many bytes
            i, x = np.append(i.astype(np.int64), size), np.append(x.astype(np.float64), 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return FtrlModel(w[:-1].astype(np.float32), float(w[-1]))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_docs: int = 6000, folds: int = 4, remainder: int = 2) -> FtrlModel:
    """Fit on at most ``max_train_docs`` labelled rows outside the held-out fold; only their hashed counts reach the driver."""
    set_batches(docs.sparkSession)
    features = text_udf(row_features, "idx binary, val binary")
    sample = labelled_texts(docs, labels, label, max_train_docs, folds, remainder)
    got = sample.select("place", "label", features("text").alias("f")).select("place", "label", "f.*").collect()
    got.sort(key=lambda r: r.place)
    return fit_ftrl([(np.frombuffer(r.idx, np.uint32), np.frombuffer(r.val, np.float32), r.label) for r in got])


def score_slice(model: FtrlModel, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """P(label 1) of every row."""
    n = len(offsets) - 1
    margin = np.full(n, model.bias)
    for idx, row in ngram_features(offsets, data):
        margin += SCALE * sum_by_row(model.weights[idx], row, n) / np.maximum(np.bincount(row, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score_quality(docs: DataFrame, model: FtrlModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches ``threshold``)."""
    set_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input
    score = text_udf(lambda offsets, data: score_slice(shared.value, offsets, data), "double")
    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
