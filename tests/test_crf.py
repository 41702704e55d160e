"""The conditional random field against enumeration of every tag sequence."""

import itertools
import math
import random

import numpy as np
import pytest

from glosspark.operators import crf

KEYS = ["doc", "sent_no"]
SCHEMA = "doc long, sent_no int, idx int, features array<string>, label string, allowed array<string>"


def score(emit, moves, path):
    return sum(emit[i][y] + moves[path[i - 1] + 1 if i else 0][y] for i, y in enumerate(path))


def every(emit, moves, allowed):
    n, k = emit.shape
    found = {p: score(emit, moves, p) for p in itertools.product(range(k), repeat=n) if all(y in a for y, a in zip(p, allowed))}
    z = math.log(sum(map(math.exp, found.values())))
    nodes, edges = np.zeros((n, k)), np.zeros((k + 1, k))
    for p, s in found.items():
        w = math.exp(s - z)
        for i, y in enumerate(p):
            nodes[i, y] += w
            edges[p[i - 1] + 1 if i else 0, y] += w
    return z, nodes, edges, sorted(found.items(), key=lambda x: -x[1])


@pytest.mark.parametrize("seed", range(5))
def test_lattice(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 6)), int(rng.integers(1, 5))
    emit, moves = rng.normal(size=(n, k)), rng.normal(size=(k + 1, k))
    allowed = [set(rng.choice(k, rng.integers(1, k + 1), replace=False).tolist()) for _ in range(n)]
    held = np.where([[y in a for y in range(k)] for a in allowed], emit, -np.inf)
    z, nodes, edges, ranked = every(emit, moves, allowed)
    got = crf.marginals(held, moves)
    assert abs(got[0] - z) < 1e-9 and np.allclose(got[1], nodes) and np.allclose(got[2], edges)
    for best in (1, 3, 1000):
        assert [(tuple(p), round(s, 9)) for s, p in crf.paths(held, moves, best)] == [(p, round(s, 9)) for p, s in ranked[:best]]


def test_ties_and_no_path():
    assert crf.paths(np.zeros((2, 2)), np.zeros((3, 2)), 10) == [(0.0, [0, 0]), (0.0, [1, 0]), (0.0, [0, 1]), (0.0, [1, 1])]
    assert crf.paths(np.array([[0.0], [-np.inf]]), np.zeros((2, 1)), 2) == []


def corpus(n, seed):
    """Noun phrases whose last word is a noun; 'run' is a noun or a verb by what stands before it."""
    rng = random.Random(seed)
    for s in range(n):
        words = rng.choice([["the", "run"], ["they", "run"], ["the", "red", "box"], ["they", "see", "the", "box"], ["they", "see", "the", "run"], ["box"]])
        tags = [{"the": "D", "they": "P", "red": "A", "box": "N", "see": "V"}.get(w) or ("N" if words[i - 1] == "the" else "V") for i, w in enumerate(words)]
        for i, (w, t) in enumerate(zip(words, tags), 1):
            yield s // 5, s % 5, i, [f"w={w}", f"l={len(w)}"], t


def table(spark, rows):
    return spark.createDataFrame([(*r[:5], None) for r in rows], SCHEMA)


def test_training_and_tagging(spark, tmp_path):
    rows = list(corpus(60, 1))
    tokens = table(spark, rows)
    model, seen = crf.train(tokens, KEYS, 12)
    assert seen[-1] > seen[0] and seen[-1] > -10 and model.labels == ["A", "D", "N", "P", "V"]
    assert abs(seen[0] + sum(math.log(5) for _ in rows)) < 1e-6  # all paths alike before the first step
    test = list(corpus(40, 2))
    got = {(r.doc, r.sent_no, r.idx): r.label for r in crf.tag(table(spark, [(*r[:4], None) for r in test]), KEYS, model).collect()}
    assert got == {r[:3]: r[4] for r in test}
    model.save(str(tmp_path / "m"))
    again = crf.Model.load(spark, str(tmp_path / "m"))
    assert abs(crf.log_likelihood(tokens, KEYS, again) - crf.log_likelihood(tokens, KEYS, model)) < 1e-9
    assert crf.train(tokens, KEYS, 2, start=again)[1][-1] > seen[-1] - 1


def test_gradient_is_the_slope(spark):
    rows = [(1, 1, 1, ["a"], "X", None), (1, 1, 2, ["a", "b"], None, ["X", "Y"]), (1, 1, 3, ["b", "zz"], None, None), (1, 2, 1, [], "Z", None), (2, 1, 1, None, None, ["Y", "unknown"])]
    tokens = spark.createDataFrame(rows, SCHEMA)
    rng = np.random.default_rng(4)
    labels, size = ["X", "Y", "Z"], 3
    w = {f: rng.normal(size=size) for f in "ab"}
    moves = rng.normal(size=(size + 1, size))

    def likelihood(w, moves):
        sents = [[(["a"], [0]), (["a", "b"], [0, 1]), (["b"], [0, 1, 2])], [([], [2])], [([], [1])]]
        total = 0.0
        for s in sents:
            emit = np.array([sum((w[f] for f in fs), np.zeros(size)) for fs, _ in s])
            total += every(emit, moves, [a for _, a in s])[0] - every(emit, moves, [range(size)] * len(s))[0]
        return total

    weights = spark.createDataFrame([(f, x.tolist(), [0.1] * size, [0.0] * size) for f, x in w.items()], crf.WEIGHTS)
    sents = crf.sentences(tokens, KEYS, labels)
    grad, across, total = crf.gradient(sents, crf._cells(sents), crf.Model(labels, weights, moves))
    assert abs(total - likelihood(w, moves)) < 1e-9
    got = {r.feature: r.g for r in grad.collect()}
    for f in "ab":
        for y in range(size):
            up, down = ({**w, f: w[f] + s * 1e-5 * np.eye(size)[y]} for s in (1, -1))
            assert abs(got[f][y] - (likelihood(up, moves) - likelihood(down, moves)) / 2e-5) < 1e-5
    for i in range(size + 1):
        for y in range(size):
            d = np.zeros_like(moves)
            d[i, y] = 1e-5
            assert abs(across[i, y] - (likelihood(w, moves + d) - likelihood(w, moves - d)) / 2e-5) < 1e-5


def test_constraints_teach(spark):
    """Without a single label: two unambiguous words and a short list for the rest."""
    rows = [(*r[:4], None, [r[4]] if r[3][0] in ("w=the", "w=they", "w=box", "w=red", "w=see") else ["N", "V"]) for r in corpus(80, 5)]
    model, _ = crf.train(spark.createDataFrame(rows, SCHEMA), KEYS, 10)
    assert set(model.labels) == {"A", "D", "N", "P", "V"}
    test = list(corpus(20, 6))
    got = {(r.doc, r.sent_no, r.idx): r.label for r in crf.tag(table(spark, [(*r[:4], None) for r in test]), KEYS, model).collect()}
    assert all(got[r[:3]] == r[4] for r in test if r[3][0] != "w=run")


def test_best_and_allowed(spark):
    tokens = spark.createDataFrame([(1, 1, 1, ["a"], None, None), (1, 1, 2, ["b"], None, ["X"]), (1, 2, 1, ["a"], None, ["none such"])], SCHEMA)
    weights = spark.createDataFrame([("a", [1.0, 2.0], [0.1] * 2, [0.0] * 2), ("b", [0.0, 9.0], [0.1] * 2, [0.0] * 2)], crf.WEIGHTS)
    got = {(r.sent_no, r.rank, r.idx, r.label, r.score) for r in crf.tag(tokens, KEYS, crf.Model(["X", "Y"], weights, np.zeros((3, 2))), best=5).collect()}
    assert {g for g in got if g[0] == 1} == {(1, 1, 1, "Y", 2.0), (1, 1, 2, "X", 2.0), (1, 2, 1, "X", 1.0), (1, 2, 2, "X", 1.0)}
    words = spark.createDataFrame([(1, "The", None), (2, "run", None)], "id long, tok string, features array<string>")
    known = spark.createDataFrame([("the", "D"), ("THE", "X")], "word string, tag string")
    assert {(r.id, tuple(r.allowed or ())) for r in crf.constrained(words, known).collect()} == {(1, ("D", "X")), (2, ())}
