"""Spanning trees, charts and taggers against enumeration and on generated sentences."""

import itertools
import math
import random

import numpy as np
import pytest

from glosspark.operators import chart, spanning, tagger, tiers

KEYS = ["s"]


def trees_over(n):
    """All head lists of trees over words 1..n."""
    for head in itertools.product(range(n + 1), repeat=n):
        def up(i, seen=()):
            return i == 0 or (i not in seen and up(head[i - 1], (*seen, i)))

        if all(up(i) for i in range(1, n + 1)):
            yield head


@pytest.mark.parametrize("seed", range(12))
def test_heads_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 5):
        score = np.round(rng.normal(size=(n + 1, n + 1)) * 3, 6)
        if seed % 2:
            score[rng.random((n + 1, n + 1)) < 0.3] = -np.inf
        total = lambda head: sum(score[h, d] for d, h in enumerate(head, 1))  # noqa: B023, E731
        best = max(map(total, trees_over(n)))
        checked = score.copy()
        np.fill_diagonal(checked, -np.inf)
        checked[:, 0] = -np.inf
        assert spanning.reaches(checked) == (best > -np.inf)
        if best > -np.inf:
            got = spanning.heads(score)
            assert tuple(got[1:]) in set(trees_over(n)) and abs(total(got[1:]) - best) < 1e-9


def test_six_words():
    rng = np.random.default_rng(99)
    every = list(trees_over(6))
    assert len(every) == 7**5
    for _ in range(3):
        score = rng.integers(0, 50, (7, 7)).astype(float)
        got = spanning.heads(score)
        assert sum(score[h, d] for d, h in enumerate(got[1:], 1)) == max(sum(score[h, d] for d, h in enumerate(head, 1)) for head in every)


def test_best_trees(spark):
    rows = [(1, 1, 0, 1.0), (1, 1, 2, 9.0), (1, 2, 1, 9.0), (1, 2, 0, 2.0), (2, 5, 0, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    got = {(r.s, r.dep, r["head"], r.score) for r in spanning.best_trees(spark.createDataFrame(rows, "s int, dep int, head int, score double"), KEYS).collect()}
    assert got == {(1, 1, 2, 9.0), (1, 2, 0, 2.0), (2, 5, 0, 1.0)}  # the third hangs nowhere


def sentence(rng):
    """(word, tag, head) of a small language: verb first or second, its nouns, their modifiers before them."""
    np_ = lambda: [("the", "D"), *([("red", "A")] if rng.random() < 0.4 else []), (rng.choice(["dog", "box", "cat"]), "N")]
    subject, obj = np_(), np_() if rng.random() < 0.6 else []
    words = [*subject, (rng.choice(["sees", "has"]), "V"), *obj]
    verb, heads = len(subject) + 1, []
    for part, start in ((subject, 1), (obj, verb + 1)):
        heads += [(start + i, start + len(part) - 1 if i < len(part) - 1 else verb) for i in range(len(part))]
    heads.append((verb, 0))
    return words, dict(heads)


def corpus(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        words, heads = sentence(rng)
        rows += [(s, i, w, t, heads[i]) for i, (w, t) in enumerate(words, 1)]
    return spark.createDataFrame(rows, "s int, idx int, tok string, label string, head int")


def test_learnt_parser(spark):
    train, test = corpus(spark, 60, 1), corpus(spark, 40, 2)
    arcs = lambda df: spanning.arc_features(df.select("s", "idx", "tok", "label"), KEYS)
    weights = spanning.parser(arcs(train), train.selectExpr("s", "idx AS dep", "head"), KEYS, 5)
    got = {(r.s, r.dep): r["head"] for r in spanning.parse(arcs(test), weights, KEYS).collect()}
    want = {(r.s, r.idx): r["head"] for r in test.collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) / len(want) > 0.98


def test_tagger(spark):
    train, test = corpus(spark, 60, 3), corpus(spark, 40, 4)
    model = tagger.train(train, KEYS, 12)
    got = {(r.s, r.idx): r.label for r in tagger.tag(test.drop("label"), KEYS, model).collect()}
    want = {(r.s, r.idx): r.label for r in test.collect()}
    assert got == want
    odd = spark.createDataFrame([(1, 1, "the"), (1, 2, "newword"), (1, 3, "sees")], "s int, idx int, tok string")
    assert [r.label for r in tagger.tag(odd, KEYS, model).orderBy("idx").collect()] == ["D", "N", "V"]


RULES = [("S", "NP VP", 0.7), ("S", "NP VP PP", 0.2), ("S", "VP", 0.1), ("NP", "N", 0.4), ("NP", "D N", 0.4), ("NP", "NP PP", 0.2), ("VP", "V", 0.3), ("VP", "V NP", 0.4), ("VP", "V NP PP", 0.2), ("VP", "VP PP", 0.1), ("PP", "P NP", 1.0)]
WORDS = [("N", "dog", 0.5), ("N", "saw", 0.2), ("N", "box", 0.3), ("V", "saw", 0.6), ("V", "dog", 0.4), ("D", "the", 1.0), ("P", "in", 1.0)]


def derivations(symbol, words, deep=0):
    """(p, brackets) of every tree of a symbol over words."""
    if len(words) == 1:
        for t, w, p in WORDS:
            if t == symbol and w == words[0]:
                yield p, f"({t} {w})"
    for lhs, rhs, p in RULES:
        if lhs != symbol:
            continue
        parts = rhs.split()
        if len(parts) == 1:
            for q, t in derivations(parts[0], words, deep + 1):
                yield p * q, f"({lhs} {t})"
            continue
        for cuts in itertools.combinations(range(1, len(words)), len(parts) - 1):
            spans = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
            for kids in itertools.product(*(list(derivations(c, s, deep + 1)) for c, s in zip(parts, spans))):
                yield p * math.prod(k[0] for k in kids), f"({lhs} {' '.join(k[1] for k in kids)})"


def test_chart_by_enumeration(spark):
    rng = random.Random(5)
    sents = [[rng.choice(["dog", "saw", "box", "the", "in"]) for _ in range(rng.randint(1, 7))] for _ in range(60)] + ["the dog saw the box in the".split(), "dog saw box in box in box".split()]
    df = spark.createDataFrame([(i, s, "own", 1) for i, s in enumerate(sents)], "i int, words array<string>, tree string, row int")
    rules, words = spark.createDataFrame(RULES, "lhs string, rhs string, p double"), spark.createDataFrame(WORDS, "tag string, word string, p double")
    found = 0
    for r in chart.parse(df, rules, words).collect():
        every = list(derivations("S", sents[r.i]))
        assert r.row == 1
        if not every:
            assert r.tree is None and r.log_p is None
            continue
        found += 1
        best = max(p for p, _ in every)
        assert abs(math.exp(r.log_p) - best) < 1e-9 * best and any(t == r.tree and abs(p - best) < 1e-9 * best for p, t in every)
    assert found > 8


def test_grammar_from_trees(spark):
    trees = spark.createDataFrame([(1, "(S (NP (D the) (N Dog)) (VP (V ran) (A fast) (P .)))"), (2, "(S (NP (N dogs)) (VP (V ran)))")], "s int, tree string")
    rules, words = chart.grammar(tiers.parsed(trees, KEYS), KEYS)
    assert {(r.lhs, r.rhs, r.p) for r in rules.collect()} == {("S", "NP VP", 1.0), ("NP", "D N", 0.5), ("NP", "N", 0.5), ("VP", "V A P", 0.5), ("VP", "V", 0.5)}
    assert {(r.tag, r.word): r.p for r in words.collect()}["N", "dog"] == 0.5
    df = spark.createDataFrame([(["the", "dogs", "ran", "fast", "."],), (["the", "unseen", "ran"],), ([],), (None,)], "words array<string>")
    got = [r.tree for r in chart.parse(df, rules, words).collect()]
    assert got == ["(S (NP (D the) (N dogs)) (VP (V ran) (A fast) (P .)))", "(S (NP (D the) (N unseen)) (VP (V ran)))", None, None]
