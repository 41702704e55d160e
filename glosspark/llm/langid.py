"""Language identification by hierarchical discrimination.

First the language family is predicted, then the closely related languages inside it are told apart by one-versus-one
linear support vector machines. Features are shares of hashed byte n-grams (``ORDERS``) over a text's distinct words. Every
machine is a linear hinge-loss classifier (AdaGrad on a fixed order, so reruns agree): one against the rest for each family
where there are two or more, one for each pair of languages inside a family. A family's languages vote by the summed
margins of their pairs. The score is the family's share (softmax of margins) times the weakest of the winner's pair probabilities.

``FAMILIES`` is a parameter; a language that it does not list is a family of its own.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if no language could be
learnt; repeated rows agree; an empty table gives an empty table; extra columns pass through (an input column with
an output's name is replaced). lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.hashing import LETTERS, sum_by_row
from glosspark.llm.samples import fold, one_text
from glosspark.llm.rows import fresh
from glosspark.llm.wordgrams import count_features, distinct_words, word_grams

BITS = 16
ORDERS = (1, 2, 3)
SCALE = 30.0
# fixed values: families of languages by ISO 639-1 code
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "bg", "sr"), "slavic"),
}


@dataclass
class LanguageModel:
    families: list[str]
    languages: list[list[str]]  # by family
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # float32, buckets x machines: families, then pairs
    bias: np.ndarray


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, epochs: int = 3, rate: float = 0.3, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """A linear support vector machine: weights and bias from sparse rows and their signs; the smaller side weighs more."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), 0.0, 1e-2
    heavy = {s: len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (-1, 1)}
    for _ in range(epochs):
        for (i, x), s in zip(rows, sign.tolist()):
            if s * (w[i] @ x + bias) < 1:
                g = -s * heavy[s] * x + l2 * w[i]
                g2[i] += g * g
                w[i] -= rate * g / np.sqrt(g2[i])
                b2 += heavy[s] ** 2
                bias += rate * s * heavy[s] / b2**0.5
    return w.astype(np.float32), bias


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], families: dict[str, str] | None = None) -> LanguageModel:
    """One-against-rest machines over families and one-versus-one machines inside them."""
    families = FAMILIES if families is None else families
    known = sorted({lang for _, _, lang in rows})
    of = {lang: families.get(lang, lang) for lang in known}
    names = sorted(set(of.values()))
    members = [[x for x in known if of[x] == f] for f in names]
    scaled = [(i.astype(np.int64), SCALE * x / max(1.0, float(x.sum())), lang) for i, x, lang in rows]
    machines = [fit_machine([(i, x) for i, x, _ in scaled], np.array([1 if of[lang] == f else -1 for *_, lang in scaled])) for f in names] if len(names) > 1 else [(np.zeros(1 << BITS, np.float32), 0.0)] * len(names)
    pairs = [(a, b) for m in members for k, a in enumerate(m) for b in m[k + 1 :]]
    for a, b in pairs:
        own = [r for r in scaled if r[2] in (a, b)]
        machines.append(fit_machine([(i, x) for i, x, _ in own], np.array([1 if lang == a else -1 for *_, lang in own])))
    weights = np.stack([w for w, _ in machines], axis=1) if machines else np.zeros((1 << BITS, 0), np.float32)
    return LanguageModel(names, members, pairs, weights, np.array([b for _, b in machines]))


def training_texts(docs: DataFrame, per_language: int, folds: int, remainder: int) -> DataFrame:
    """At most ``per_language`` rows ``(doc_id, lang, text, place)`` of each language outside the held-out fold, chosen by the hash of the id."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != remainder)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # a share of each language by its hash first, twice as many as asked for, so that no task ranks all rows of a language
    many = ids.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * F.col("n")
    few = ids.join(many, "lang").filter(share < 2 * per_language).select("doc_id", "lang")
    few = few.withColumn("rn", F.expr("row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id)")).filter(F.col("rn") <= per_language).drop("rn")
    return one_text(docs.select("doc_id", "text").join(few, "doc_id"), "lang")


def train_languages(docs: DataFrame, per_language: int = 1500, folds: int = 5, remainder: int = 0, families: dict[str, str] | None = None) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language; only their hashed counts reach the driver."""
    set_batches(docs.sparkSession)
    features = text_udf(lambda o, d: count_features(o, d, ORDERS, BITS), "idx binary, val binary", 1 << 20)
    got = training_texts(docs, per_language, folds, remainder).select("place", "lang", features("text").alias("f")).select("place", "lang", "f.*").collect()
    got.sort(key=lambda r: r.place)
    return fit([(np.frombuffer(r.idx, np.uint32), np.frombuffer(r.val, np.float32), r.lang) for r in got if r.idx], families)


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter; only rows without an ASCII letter are looked at as characters."""
    n = len(offsets) - 1
    ascii_ = np.concatenate([[0], np.cumsum((LETTERS[data] == 1) & (data < 128))])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out if n else np.zeros(0, bool)


def predict_slice(model: LanguageModel, offsets: np.ndarray, data: np.ndarray) -> dict:
    n = len(offsets) - 1
    start, end, row, word = distinct_words(offsets, data)
    bucket, owner = word_grams(data, start, end, ORDERS, BITS)
    grams = np.bincount(owner, minlength=len(start))
    total = np.maximum(sum_by_row(grams[word], row, n), 1)
    margin = np.empty((n, model.weights.shape[1]))
    for k in range(model.weights.shape[1]):
        by_word = sum_by_row(model.weights[bucket, k], owner, len(start))
        margin[:, k] = SCALE * sum_by_row(by_word[word], row, n) / total + model.bias[k]
    letters = has_letter(offsets, data)
    if not model.families:
        return {"lang_pred": ["und"] * n, "score": np.zeros(n)}
    f = len(model.families)
    share = np.exp(margin[:, :f] - margin[:, :f].max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    lang, score = np.empty(n, object), np.zeros(n)
    for k, members in enumerate(model.languages):
        own = np.flatnonzero(best == k)
        votes, least = np.zeros((len(own), len(members))), np.ones((len(own), len(members)))
        for j, (a, b) in enumerate(model.pairs):
            if a in members:
                m = margin[own, f + j]
                p = 1 / (1 + np.exp(-np.clip(2 * m, -35, 35)))
                for name, sign, q in ((a, 1, p), (b, -1, 1 - p)):
                    i = members.index(name)
                    votes[:, i] += sign * m
                    least[:, i] = np.minimum(least[:, i], q)
        pick = votes.argmax(1)
        lang[own] = np.array(members, object)[pick]
        score[own] = share[own, k] * least[np.arange(len(own)), pick]
    return {"lang_pred": pa.array(np.where(letters, lang, "und").tolist(), pa.string()), "score": np.where(letters, score, 0.0)}


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    set_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats a machine, whatever the number of rows
    work = text_udf(lambda o, d: predict_slice(shared.value, o, d), "lang_pred string, score double", 2 << 20)
    own = fresh(docs, "_l")
    out = docs.withColumn(own, work(F.col(text)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")), f"{own}.*")
