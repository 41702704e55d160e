"""Tree tables and tiers against recursive constructions of their own."""

import collections
import random

import pytest

from glosspark.operators import tiers, trees
from glosspark.sources import igt_xml

KEYS = ["igt_id"]


def grow(rng, n, deep):
    """(label, children) over n words, or (label, word)."""
    if n == 1 and (deep > 5 or rng.random() < 0.7):
        return rng.choice(["N", "V", "P.x", "D-1"]), f"w{rng.randint(0, 30)}"
    cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(3, n - 1)))) if n > 1 else []
    return rng.choice(["S", "NP", "VP", "X"]), [grow(rng, b - a, deep + 1) for a, b in zip([0, *cuts], [*cuts, n])]


def text(t):
    return f"({t[0]} {t[1]})" if isinstance(t[1], str) else f"({t[0]} {' '.join(map(text, t[1]))})"


def leaves(t):
    return [t[1]] if isinstance(t[1], str) else [x for c in t[1] for x in leaves(c)]


def walk(t):
    yield t
    if not isinstance(t[1], str):
        for c in t[1]:
            yield from walk(c)


def forest(n, seed):
    rng = random.Random(seed)
    return {i: ("TOP", [grow(rng, rng.randint(1, 9), 0)]) for i in range(n)}


def tables(spark, trees_of):
    t = spark.createDataFrame([(i, text(x)) for i, x in trees_of.items()], "igt_id long, tree string")
    w = spark.createDataFrame([(i, k, f"w{k}", x) for i, tree in trees_of.items() for k, x in enumerate(leaves(tree), 1)], "igt_id long, idx int, item_id string, tok string")
    return t, w


def test_ten_thousand_trees_there_and_back(spark):
    own = forest(10_000, 1)
    t, w = tables(spark, own)
    nodes = tiers.parsed(t, KEYS)
    assert {(r.igt_id, r.tree) for r in tiers.brackets(nodes, KEYS).collect()} == {(i, text(x)) for i, x in own.items()}
    items = tiers.phrase_items(nodes, w, KEYS)
    back = tiers.brackets(tiers.phrase_nodes(items, w, KEYS), KEYS)
    assert {(r.igt_id, r.tree) for r in back.collect()} == {(i, text(x)) for i, x in own.items()}


def test_items_and_nodes(spark):
    own = forest(60, 2)
    t, w = tables(spark, own)
    nodes = tiers.parsed(t, KEYS)
    python = trees.nodes(t).collect()  # the batch parser has a row for each word too
    assert {(r.igt_id, r.label, r.ord) for r in nodes.collect()} <= {(r.igt_id, r.label, r.ord) for r in python}
    items = collections.defaultdict(list)
    for r in tiers.phrase_items(nodes, w, KEYS).orderBy("idx").collect():
        items[r.igt_id].append((r.item_id, r.text, r.alignment, r.children))
    for i, tree in own.items():
        every = list(walk(tree))
        pre, inner = [x for x in every if isinstance(x[1], str)], [x for x in every if not isinstance(x[1], str)]
        number = {id(x): f"ps{k}" for k, x in enumerate([*pre, *inner], 1)}
        want = [(number[id(x)], x[0], f"w{k}", None) for k, x in enumerate(pre, 1)] + [(number[id(x)], x[0], None, " ".join(number[id(c)] for c in x[1])) for x in inner]
        assert items[i] == want


def test_odd_texts(spark):
    t = spark.createDataFrame([(1, "(S (NP the dog) (V ran))"), (2, "((A a))"), (3, "(A (B b) c)"), (4, "")], "igt_id long, tree string")
    got = collections.defaultdict(set)
    for r in tiers.parsed(t, KEYS).collect():
        got[r.igt_id].add((r.node, r.parent, r.label, r.depth, r.word_idx, r.word))
    assert got[1] == {(1, None, "S", 1, None, None), (2, 1, "NP", 2, None, None), (None, 2, None, 3, 1, "the"), (None, 2, None, 3, 2, "dog"), (3, 1, "V", 2, 3, "ran")}
    assert got[2] == {(1, None, "", 1, None, None), (2, 1, "A", 2, 1, "a")}
    assert 4 not in got
    words = spark.createDataFrame([(i, k, f"w{k}", "x") for i in (1, 2, 3) for k in (1, 2)], "igt_id long, idx int, item_id string, tok string")
    assert tiers.phrase_items(tiers.parsed(t, KEYS), words, KEYS).count() == 0  # words beside children, or too many words
    assert tiers.parsed(t.filter("false"), KEYS).count() == 0


def test_problems(spark):
    schema = "igt_id long, idx int, item_id string, text string, alignment string, children string"
    rows = [
        (1, 1, "a", "N", "w1", None), (1, 2, "b", "S", None, "a zz"),
        (2, 1, "a", "N", "w1", None), (2, 2, "b", "S", None, "a"), (2, 3, "c", "T", None, "a"),
        (3, 1, "a", "N", "w9", None), (3, 2, "b", "S", None, "a"),
        (4, 1, "a", "S", None, "b"), (4, 2, "b", "S", None, "a"),
        (5, 1, "a", "N", "w1", "b"), (5, 2, "b", "S", None, None),
        (6, 1, "a", "N", "w1", None), (6, 2, "b", "S", None, " a  "),
    ]
    items = spark.createDataFrame(rows, schema)
    words = spark.createDataFrame([(i, 1, "w1", "x") for i in range(1, 7)], "igt_id long, idx int, item_id string, tok string")
    found = collections.defaultdict(set)
    for r in tiers.phrase_problems(items, words, KEYS).collect():
        found[r.igt_id].add(r.problem)
    assert found == {1: {"missing child"}, 2: {"two parents", "several roots"}, 3: {"no word"}, 4: {"no root"}, 5: {"no children", "both"}}
    assert {(r.igt_id, r.tree) for r in tiers.brackets(tiers.phrase_nodes(items, words, KEYS), KEYS).collect()} == {(6, "(S (N x))")}


def random_edges(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        size = rng.randint(1, 8)
        order = rng.sample(range(1, size + 1), size)
        for k, d in enumerate(order):
            yield i, d, rng.choice([0, *order[:k]]) if k else 0, rng.choice(["a", "b"])


def test_dependencies_there_and_back(spark):
    rows = list(random_edges(500, 3))
    edges = spark.createDataFrame(rows, "igt_id long, dep int, head int, type string")
    words = edges.selectExpr("igt_id", "dep AS idx", "'w' || dep AS item_id", "'t' || dep AS tok")
    tags = words.selectExpr("igt_id", "idx", "'N' || idx AS label")
    items = tiers.dependency_items(edges, words, KEYS)
    got = {tuple(r) for r in tiers.dependency_edges(items, words, KEYS, tags).collect()}
    assert got == {(i, d, h, t, f"t{d}", f"N{d}") for i, d, h, t in rows}
    order = collections.defaultdict(list)
    for r in items.orderBy("idx").collect():
        assert r.item_id == f"ds{r.idx}"
        order[r.igt_id].append(int(r.dep[1:]))
    under = collections.defaultdict(list)
    for i, d, h, _ in rows:
        under[i, h].append(d)

    def visit(i, h):
        return [x for d in sorted(under[i, h]) for x in [d, *visit(i, d)]]

    assert all(order[i] == visit(i, 0) for i in order)
    assert tiers.loose_edges(edges, KEYS).count() == 0


def test_loose_and_double_edges(spark):
    edges = spark.createDataFrame([(1, 1, 0, "r"), (1, 2, 1, "x"), (1, 3, 4, "x"), (1, 4, 3, "x"), (1, 2, 0, "y"), (1, 5, 2, "z")], "igt_id long, dep int, head int, type string")
    assert {(r.dep, r["head"]) for r in tiers.loose_edges(edges, KEYS).collect()} == {(3, 4), (4, 3)}
    words = spark.createDataFrame([(1, k, f"w{k}", "x") for k in range(1, 6)], "igt_id long, idx int, item_id string, tok string")
    got = {(r.dep, r["head"], r.type) for r in tiers.dependency_edges(tiers.dependency_items(edges, words, KEYS), words, KEYS).collect()}
    assert got == {(1, 0, "r"), (2, 1, "x"), (2, 0, "y"), (5, 2, "z")}


def test_tiers_through_xml(spark, tmp_path):
    own = forest(40, 4)
    t, w = tables(spark, own)
    items = tiers.phrase_items(tiers.parsed(t, KEYS), w, KEYS).withColumn("igt_id", tiers.F.concat(tiers.F.lit("i"), "igt_id"))
    igt = spark.createDataFrame([(f"i{i}", [(None,)] and None) for i in own], f"_id string, tier {igt_xml.TIER}")
    word_items = w.selectExpr("'i' || igt_id AS igt_id", "'t' AS tier_id", "idx", "item_id", "tok AS text")
    full = igt_xml.with_tier(igt_xml.with_tier(igt, word_items, "words"), items, "phrase-structure", "parser", alignment="t", children="ps")
    igt_xml.write(igt_xml.with_tier(full, word_items, "words"), str(tmp_path / "x"))  # a tier given again replaces itself
    back = igt_xml.load(spark, str(tmp_path / "x"))
    table = igt_xml.items(back)
    words = table.filter("tier_type = 'words'").selectExpr("igt_id", "idx", "item_id", "text AS tok")
    assert words.count() == w.count()
    got = tiers.brackets(tiers.phrase_nodes(table.filter("tier_type = 'phrase-structure'"), words, KEYS), KEYS)
    assert {(r.igt_id, r.tree) for r in got.collect()} == {(f"i{i}", text(x)) for i, x in own.items()}
    assert {(r.tier_id, r.method, r.children) for r in igt_xml.tiers(back).filter("type = 'phrase-structure'").collect()} == {("ps", "parser", "ps")}


@pytest.mark.parametrize("seed", [5, 6])
def test_neighbours_and_attachment(spark, seed):
    rng = random.Random(seed)
    tokens, covered, edges, want, hang = [], [], [], set(), set()
    for i in range(200):
        n = rng.randint(1, 9)
        held = [k for k in range(1, n + 1) if rng.random() < 0.5]
        own = [(i, d, rng.choice([0, *held])) for d in held]
        own = [(i, d, h) for i, d, h in own if d != h]
        tokens += [(i, k) for k in range(1, n + 1)]
        covered += [(i, k) for k in held]
        edges += own
        for k in set(range(1, n + 1)) - set(held):
            left, right = max((x for x in held if x < k), default=None), min((x for x in held if x > k), default=None)
            want.add((i, k, left, right))
            if left is None or right is None:
                hang |= {(i, k, x) for x in (left, right) if x}
            else:
                around = sorted((abs(k - h) + abs(k - d), h, d) for _, d, h in own if min(d, h) < k < max(d, h))
                hang |= {(i, k, around[0][2])} if around else set()
    t, c = (spark.createDataFrame(x, "igt_id long, idx int") for x in (tokens, covered))
    e = spark.createDataFrame(edges, "igt_id long, dep int, head int")
    assert {tuple(r) for r in tiers.nearest_aligned(t, c, KEYS).collect()} == want
    assert {tuple(r) for r in tiers.attached(e, t, c, KEYS).collect()} == hang
