"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang & Manning 2012).

A text's features count its distinct words: each word is lower-cased (A-Z), framed by marks, and cut into byte n-grams of
``ORDERS``, hashed into ``2**BITS`` buckets. From the labelled sample each bucket f gets the ratio
``r = log(P(f | toxic) / P(f | not toxic))`` of its document frequencies, shrunk towards its overall frequency so that rare
n-grams say little, and is 0 where the classes differ by no more than chance (one-degree chi-square under ``CHI2``). Logistic regression on the features times ``r`` (AdaGrad, fixed order, so reruns agree) gives the
weights. Scoring works out each distinct word of a slice once and adds words up by document.

Defined results: null and empty texts have no n-gram and score the bias alone; repeated rows score alike; an
empty table gives an empty table; without labels of both kinds the model scores the prior (0.5 with none) everywhere;
extra columns pass through (an input column with an output's name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.hashing import sum_by_row
from glosspark.llm.samples import labelled_texts
from glosspark.llm.wordgrams import count_features, distinct_words, word_grams

BITS = 18
ORDERS = (3, 4, 5)
SHRINK = 20.0
CHI2 = 15.0  # a bucket's ratio counts where its share in either class differs beyond chance


@dataclass
class ToxicModel:
    weights: np.ndarray  # float32: learnt weight times log-count ratio
    bias: float


def row_features(offsets: np.ndarray, data: np.ndarray) -> dict:
    return count_features(offsets, data, ORDERS, BITS)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, rate: float = 0.1, l2: float = 1e-5) -> ToxicModel:
    """Log-count ratios, then logistic regression on the scaled features."""
    size = 1 << BITS
    df = np.zeros((2, size))
    for i, _, y in rows:
        df[y, i] += 1
    n = np.array([sum(y == c for _, _, y in rows) for c in (0, 1)], float)
    if n.min() == 0:
        return ToxicModel(np.zeros(size, np.float32), 0.0 if n.sum() == 0 else (4.0 if n[1] else -4.0))
    share = df.sum(0) / n.sum()
    rest = (df + SHRINK * share) / (n + SHRINK)[:, None]
    ratio = np.zeros(size)
    expected = share * n[1]
    seen = (share > 0) & ((df[1] - expected) ** 2 > CHI2 * expected * (1 - share) * n[0] / n.sum())
    ratio[seen] = np.log(rest[1, seen] / rest[0, seen])
    v, g2 = np.full(size, 0.1), np.full(size, 1e-3)
    bias, b2 = float(np.log(n[1] / n[0])), 1e-3
    scaled = [(i[ratio[i] != 0], (x * ratio[i])[ratio[i] != 0].astype(np.float32), y) for i, x, y in rows]
    for _ in range(epochs):
        for i, x, y in scaled:
            i = i.astype(np.int64)
            p = 1 / (1 + np.exp(-np.clip(v[i] @ x + bias, -35, 35)))
            g = (p - y) * x + l2 * v[i]
            g2[i] += g * g
            v[i] -= rate * g / np.sqrt(g2[i])
            b2 += (p - y) ** 2
            bias -= rate * (p - y) / b2**0.5
    return ToxicModel((v * ratio).astype(np.float32), float(bias))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train_docs: int = 8000, folds: int = 4, remainder: int = 2) -> ToxicModel:
    """Fit on at most ``max_train_docs`` labelled rows outside the held-out fold; only their hashed counts reach the driver."""
    set_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, label, max_train_docs, folds, remainder)
    got = sample.select("place", "label", text_udf(row_features, "idx binary, val binary", 1 << 20)("text").alias("f")).select("place", "label", "f.*").collect()
    got.sort(key=lambda r: r.place)
    return fit([(np.frombuffer(r.idx, np.uint32), np.frombuffer(r.val, np.float32), r.label) for r in got])


def score_slice(model: ToxicModel, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """P(toxic) of every row."""
    start, end, row, word = distinct_words(offsets, data)
    bucket, owner = word_grams(data, start, end, ORDERS, BITS)
    by_word = sum_by_row(model.weights[bucket], owner, len(start))
    margin = model.bias + sum_by_row(by_word[word], row, len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches ``threshold``)."""
    set_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input
    score = text_udf(lambda offsets, data: score_slice(shared.value, offsets, data), "double", 2 << 20)
    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
