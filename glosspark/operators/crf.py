"""Linear-chain conditional random fields over token features: training, n-best tagging, constrained lattices.

``tokens(key.., idx, features[, label][, allowed])``: ``features`` is an array of names, ``label`` a token's tag, ``allowed`` the tags that it
may have; null in both leaves it free. A labelled token is one whose only allowed tag is its label, so labelled, partly labelled and
constrained sentences train alike: the gradient is the expectation over the paths that the tags allow, less that over all paths.

Weights are a table, a row of one value a label for each feature; transitions between labels are a small matrix. Equal sentences
are one row with their number. In every iteration each sentence gets the weights of its own features by a join and runs forward and backward in an Arrow batch; only gradient sums are
shuffled, and the table is updated by resilient steps (the sign of each derivative, with a step size of its own). The number of labels is
bounded by ``LABELS``, so the matrix and the label names are constants of the plan.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.session import cut, ship, wide

LABELS = 1000
FIRST_STEP, LEAST_STEP, LARGEST_STEP = 0.1, 1e-6, 5.0
WEIGHTS = "feature string, w array<double>, step array<double>, last array<double>"


@dataclass
class Model:
    """Labels in order, ``weights(feature, w, step, last)``, and transitions: row 0 from the beginning, row k + 1 from label k."""

    labels: list[str]
    weights: DataFrame
    moves: np.ndarray

    def save(self, path: str) -> None:
        self.weights.write.parquet(f"{path}/weights")
        self.weights.sparkSession.createDataFrame([(json.dumps({"labels": self.labels, "moves": self.moves.tolist()}),)], "value string").write.text(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        kept = json.loads(spark.read.text(f"{path}/labels").first().value)
        return Model(kept["labels"], spark.read.schema(WEIGHTS).parquet(f"{path}/weights"), np.array(kept["moves"]).reshape(-1, len(kept["labels"])))


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponentials, -inf where all are."""
    top = x.max(axis, keepdims=True)
    top[~np.isfinite(top)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(emit: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z, label marginals [token, label] and expected transitions [from, to] of a sentence; a label that is ruled out has the score -inf."""
    n, k = emit.shape
    forward, back = np.empty((n, k)), np.zeros((n, k))
    forward[0] = moves[0] + emit[0]
    for i in range(1, n):
        forward[i] = _sum(forward[i - 1][:, None] + moves[1:], 0) + emit[i]
    for i in range(n - 2, -1, -1):
        back[i] = _sum(moves[1:] + (emit[i + 1] + back[i + 1])[None, :], 1)
    z = float(_sum(forward[-1], 0))
    nodes, edges = np.exp(forward + back - z), np.zeros((k + 1, k))
    edges[0] = nodes[0]
    for i in range(1, n):
        edges[1:] += np.exp(forward[i - 1][:, None] + moves[1:] + (emit[i] + back[i])[None, :] - z)
    return z, nodes, edges


def paths(emit: np.ndarray, moves: np.ndarray, best: int) -> list[tuple[float, list[int]]]:
    """The ``best`` highest paths in descending order of score; of equal scores the smaller labels first at the last token where they differ."""
    n, k = emit.shape
    held = [[(moves[0, y] + emit[0, y], -1, -1)] if emit[0, y] > -np.inf else [] for y in range(k)]
    trail = [held]
    for i in range(1, n):
        now = []
        for y in range(k):
            options = [(s + moves[x + 1, y] + emit[i, y], x, r) for x in range(k) for r, (s, *_) in enumerate(held[x])] if emit[i, y] > -np.inf else []
            options.sort(key=lambda o: (-o[0], o[1], o[2]))
            now.append(options[:best])
        held = now
        trail.append(held)
    ends = sorted(((s, y, r) for y in range(k) for r, (s, *_) in enumerate(held[y])), key=lambda o: (-o[0], o[1], o[2]))[:best]
    out = []
    for score, y, r in ends:
        path = []
        for i in range(n - 1, -1, -1):
            path.append(y)
            _, y, r = trail[i][y][r]
        out.append((float(score), path[::-1]))
    return out


def sentences(tokens: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``(sent, key.., times 1, tokens array<struct<idx, features, allowed array<int>>>)``; ``allowed`` empty where every label may stand."""
    at = F.array(*map(F.lit, labels))
    none = F.array().cast("array<int>")
    places = lambda names: F.filter(F.transform(names, lambda x: F.array_position(at, x).cast("int") - 1), lambda i: i >= 0)
    allowed = places(F.coalesce("allowed", F.array().cast("array<string>"))) if "allowed" in tokens.columns else none
    if "label" in tokens.columns:
        allowed = F.when(F.col("label").isNotNull(), places(F.array("label"))).otherwise(allowed)
    rows = tokens.select(*keys, F.struct("idx", F.coalesce("features", F.array().cast("array<string>")).alias("features"), allowed.alias("allowed")).alias("t"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("tokens")).withColumn("sent", F.to_json(F.struct(*keys))).withColumn("times", F.lit(1))


def _alike(sents: DataFrame) -> DataFrame:
    """``(sent, tokens, times)``: equal sentences as one row with their number, under the name of the first."""
    return sents.groupBy("tokens").agg(F.min("sent").alias("sent"), F.sum("times").alias("times"))


def _weighted(sents: DataFrame, cells: DataFrame, model: Model) -> DataFrame:
    """Sentences with the weights of their features."""
    ship(sents.sparkSession)
    found = cells.drop("times").join(model.weights.select("feature", "w"), "feature").groupBy("sent").agg(F.collect_list(F.struct("feature", "w")).alias("weights"))
    return sents.join(wide(found), "sent", "left")


def _cells(sents: DataFrame) -> DataFrame:
    return sents.select("sent", "times", F.explode(F.array_distinct(F.flatten(F.transform("tokens", lambda t: t["features"])))).alias("feature"))


def scores(tokens, weights, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores [token, label] of a sentence, and the same with what is not allowed at -inf."""
    known = {x["feature"]: np.asarray(x["w"]) for x in (weights if weights is not None else ())}
    emit = np.zeros((len(tokens), size))
    held = np.full((len(tokens), size), -np.inf)
    for i, t in enumerate(tokens):
        for f in t["features"]:
            if f in known:
                emit[i] += known[f]
        rows = list(t["allowed"]) or slice(None)
        held[i, rows] = emit[i, rows]
    return emit, held


def gradient(sents: DataFrame, cells: DataFrame, model: Model) -> tuple[DataFrame, np.ndarray, float]:
    """``(feature, g)`` by feature, that of the transitions, and the log likelihood of what the tags allow."""
    moves, size = model.moves, len(model.labels)

    def run(batches):
        import pandas as pd

        for batch in batches:
            sums, edges, total = defaultdict(lambda: np.zeros(size)), np.zeros((size + 1, size)), 0.0
            for tokens, weights, n in zip(batch.tokens, batch.weights, batch.times):
                emit, held = scores(tokens, weights, size)
                z, nodes, across = marginals(emit, moves)
                given, own, own_across = marginals(held, moves)
                total += n * (given - z)
                edges += n * (own_across - across)
                for t, g in zip(tokens, n * (own - nodes)):
                    for f in t["features"]:
                        sums[f] += g
            rows = [(0, f, g.tolist()) for f, g in sums.items()]
            rows += [(1, str(i), r.tolist()) for i, r in enumerate(edges)]
            rows.append((2, "", [total] * size))
            yield pd.DataFrame(rows, columns=["kind", "feature", "g"])

    found = _weighted(sents, cells, model).select("tokens", "weights", "times").mapInPandas(run, "kind int, feature string, g array<double>")
    found = cut(found.groupBy("kind", "feature").agg(F.array(*(F.sum(F.col("g")[y]) for y in range(size))).alias("g")))
    small = {(r.kind, r.feature): r.g for r in found.filter("kind > 0").collect()}  # a row a label, and one
    across = np.array([small.get((1, str(i)), [0.0] * size) for i in range(size + 1)])
    return found.filter("kind = 0").select("feature", "g"), across, small[2, ""][0] if (2, "") in small else 0.0


_STEPPED = """transform(arrays_zip(w, step, last, g), x -> named_struct('w', x.w, 'g', x.g - {l2} * x.w, 'turn', x.last * (x.g - {l2} * x.w), 'step', x.step))"""
_NEXT = f"""transform(moved, x -> named_struct(
    'step', CASE WHEN x.turn > 0 THEN least(x.step * 1.2D, {LARGEST_STEP}D) WHEN x.turn < 0 THEN greatest(x.step * 0.5D, {LEAST_STEP}D) ELSE x.step END, 'g', CASE WHEN x.turn < 0 THEN 0D ELSE x.g END, 'w', x.w))"""


def _table_step(weights: DataFrame, grad: DataFrame, size: int, l2: float) -> DataFrame:
    zeros = F.array(*[F.lit(0.0)] * size)
    rows = weights.join(grad, "feature", "left").withColumn("g", F.coalesce("g", zeros))
    rows = rows.withColumn("moved", F.expr(_STEPPED.format(l2=l2))).withColumn("moved", F.expr(_NEXT))
    return rows.select("feature", F.transform("moved", lambda x: x["w"] + F.signum(x["g"]) * x["step"]).alias("w"), F.transform("moved", lambda x: x["step"]).alias("step"), F.transform("moved", lambda x: x["g"]).alias("last"))


def _matrix_step(w: np.ndarray, step: np.ndarray, last: np.ndarray, g: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = g - l2 * w
    turn = last * g
    step = np.where(turn > 0, np.minimum(step * 1.2, LARGEST_STEP), np.where(turn < 0, np.maximum(step * 0.5, LEAST_STEP), step))
    g = np.where(turn < 0, 0.0, g)
    return w + np.sign(g) * step, step, g


def label_names(tokens: DataFrame) -> list[str]:
    """All labels and allowed labels in order; more than ``LABELS`` raise."""
    parts = [F.array(F.col("label"))] * ("label" in tokens.columns) + [F.col("allowed")] * ("allowed" in tokens.columns)
    names = tokens.select(F.explode(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))).alias("x")).filter("x IS NOT NULL").distinct().limit(LABELS + 1).collect()
    if len(names) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    return sorted(r.x for r in names)


def train(tokens: DataFrame, keys: list[str], iterations: int = 30, l2: float = 0.1, least: int = 1, start: Model | None = None) -> tuple[Model, list[float]]:
    """A model and the log likelihood before each iteration; features in fewer than ``least`` sentences are left out. ``start`` goes on from a model."""
    labels = start.labels if start else label_names(tokens)
    sents = cut(_alike(sentences(tokens, keys, labels)))
    cells = _cells(sents)
    if start:
        model = start
    else:
        flat = lambda v: F.array(*[F.lit(v)] * len(labels)).cast("array<double>")
        known = cells.groupBy("feature").agg(F.sum("times").alias("n")).filter(F.col("n") >= least)
        model = Model(labels, cut(known.select("feature", flat(0.0).alias("w"), flat(FIRST_STEP).alias("step"), flat(0.0).alias("last"))), np.zeros((len(labels) + 1, len(labels))))
    cells = cut(cells.join(model.weights.select("feature"), "feature", "left_semi"))
    step, last, seen = np.full(model.moves.shape, FIRST_STEP), np.zeros(model.moves.shape), []
    for _ in range(iterations):
        grad, across, now = gradient(sents, cells, model)
        seen.append(now)
        moves, step, last = _matrix_step(model.moves, step, last, across, l2)
        model = Model(labels, cut(_table_step(model.weights, grad, len(labels), l2)), moves)
    return model, seen


def log_likelihood(tokens: DataFrame, keys: list[str], model: Model) -> float:
    sents = cut(_alike(sentences(tokens, keys, model.labels)))
    return gradient(sents, _cells(sents), model)[2]


def tag(tokens: DataFrame, keys: list[str], model: Model, best: int = 1) -> DataFrame:
    """``(key.., rank, idx, label, score)``: the ``best`` paths of each sentence among those that ``allowed`` leaves; labels of the input count for nothing.

    A sentence that no path is left for has no row.
    """
    labels, moves = model.labels, model.moves
    free = tokens.drop("label") if "label" in tokens.columns else tokens
    sents = cut(sentences(free, keys, labels))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for sent, tokens_, weights in zip(batch.sent, batch.tokens, batch.weights):
                _, held = scores(tokens_, weights, len(labels))
                for rank, (score, path) in enumerate(paths(held, moves, best), 1):
                    rows += [(sent, rank, t["idx"], labels[y], score) for t, y in zip(tokens_, path)]
            yield pd.DataFrame(rows, columns=["sent", "rank", "idx", "label", "score"])

    each = cut(_alike(sents))
    found = _weighted(each, _cells(each), model).select("sent", "tokens", "weights").mapInPandas(run, "sent string, rank int, idx int, label string, score double")
    named = sents.select(*keys, "tokens").join(wide(each.select("tokens", "sent")), "tokens").select("sent", *keys)
    return named.join(wide(found), "sent").select(*keys, "rank", "idx", "label", "score")


def constrained(tokens: DataFrame, constraints: DataFrame) -> DataFrame:
    """``tokens(.., tok)`` with ``allowed``, the tags of ``constraints(word, tag)``, words without regard to case; a word without a row is free."""
    known = constraints.groupBy(F.lower("word").alias("_w")).agg(F.sort_array(F.collect_set("tag")).alias("allowed"))
    return tokens.join(known, F.lower("tok") == F.col("_w"), "left").drop("_w")
