"""Alignment algebra, heuristics, symmetrization, projection, evaluation."""

import random

from glosspark.operators import align, evaluate, project

K = ["k"]


def aln(spark, pairs):
    return spark.createDataFrame([(1, s, t) for s, t in pairs], "k int, src int, tgt int")


def toks(spark, text):
    return spark.createDataFrame([(1, i, w) for i, w in enumerate(text.split(), 1)], "k int, idx int, tok string")


def pairs(df):
    return {(r.src, r.tgt) for r in df.collect()}


def grown(a, b):
    """Neighbours, in the union, of what both have, that cover an open word; then what of the first, and then of the second, covers one still open."""
    core, both = a & b, a | b
    is_open = lambda p, now: p[0] not in {s for s, _ in now} or p[1] not in {t for _, t in now}
    near = {(s + x, t + y) for s, t in core for x in (-1, 0, 1) for y in (-1, 0, 1)}
    once = core | {p for p in both & near if is_open(p, core)}
    last = once | {p for p in a if is_open(p, once)}
    return once, last | {p for p in b if is_open(p, last)}


def test_symmetrization(spark):
    rng = random.Random(12)
    for _ in range(3):
        a, b = ({(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(7)} for _ in range(2))
        x, y = aln(spark, sorted(a)), aln(spark, sorted(b))
        assert pairs(align.intersection(x, y, K)) == a & b and pairs(align.union(x, y, K)) == a | b
        once, last = grown(a, b)
        assert pairs(align.grow_diag(x, y, K)) == once
        assert pairs(align.grow_diag_final(x, y, K)) == last
        assert a & b <= pairs(align.refined(x, y, K)) <= a | b


def test_heuristics(spark):
    g, t = toks(spark, "small Dogs bark at night 1SG"), toks(spark, "at night I hear small   dog barked")
    from pyspark.sql import functions as F

    from glosspark.functions.stem import stems

    equal, stemmed, gram = {(1, 5), (4, 1), (5, 2)}, {(2, 6), (3, 7)}, {(6, 3)}
    assert pairs(align.matched(g, t, K, lambda x: x)) == equal
    assert pairs(align.matched(g, t, K, lambda x: stems(F.lower(x)))) == equal | stemmed
    assert pairs(align.gram_matched(g, t, K)) == gram
    assert pairs(align.heuristic(g, t, K)) == equal | stemmed | gram


def scan(g, t, multi):
    out, used = set(), set()
    for i, x in enumerate(g, 1):
        for j, y in enumerate(t, 1):
            if x == y and j not in used:
                out.add((i, j))
                used.add(j)
                break
    if multi:
        done = {i for i, _ in out}
        out |= {(i, j) for i, x in enumerate(g, 1) if i not in done for j, y in enumerate(t, 1) if x == y}
    return out


def test_matching_is_the_scan(spark):
    rng = random.Random(3)
    rows_g, rows_t, want = [], [], {False: set(), True: set()}
    for k in range(60):
        g, t = [rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        rows_g += [(k, i, w) for i, w in enumerate(g, 1)]
        rows_t += [(k, i, w) for i, w in enumerate(t, 1)]
        for multi in want:
            want[multi] |= {(k, *p) for p in scan(g, t, multi)}
    s, t = (spark.createDataFrame(r, "k int, idx int, tok string") for r in (rows_g, rows_t))
    for multi in want:
        assert {tuple(r) for r in align.matched(s, t, K, multi=multi).select("k", "src", "tgt").collect()} == want[multi]


def test_morph_align(spark):
    g = spark.createDataFrame([(1, 1, 1, "-"), (1, 2, 1, "."), (1, 3, 1, " "), (1, 4, 2, None)], "k int, idx int, word_idx int, gap string")
    m = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 2, "c")], "k int, idx int, word_idx int, tok string")
    assert pairs(align.morph_align(g, m, K)) == {(1, 1), (2, 2), (3, 2), (4, 3)}


def test_nulls_and_a3(spark):
    from pyspark.sql import functions as F

    s, t = toks(spark, "a b"), toks(spark, "c d")
    assert pairs(align.with_nulls(aln(spark, [(1, 2)]), s, t, K)) == {(1, 2), (2, 0), (0, 1)}
    got = spark.createDataFrame([("NULL ({ 2 }) aa ({ }) bb ({ 1 3 })",)], "v string").select(align.from_a3(F.col("v")).alias("p")).first().p
    assert [tuple(p) for p in got] == [(0, 2), (2, 1), (2, 3)]


def test_projection(spark):
    tags = spark.createDataFrame([(1, 1, "DET"), (1, 2, "NOUN"), (1, 3, "XX"), (1, 4, "VERB")], "k int, idx int, label string")
    a = aln(spark, [(1, 1), (2, 1), (3, 2), (4, 2), (4, 3), (5, 4)])
    assert {(r.idx, r.label) for r in project.by_precedence(a, tags, K).collect()} == {(1, "NOUN"), (2, "XX"), (3, "VERB")}
    assert {(r.idx, r.label) for r in project.across(a, tags, K, "UNK").filter("idx = 4").collect()} == {(4, "UNK")}


def test_evaluation(spark):
    p = spark.createDataFrame([("NOUN", "NOUN"), ("NOUN", "VERB"), ("NOUN", "VERB"), ("VERB", "NOUN"), ("VERB", "VERB")], "gold string, pred string")
    m = evaluate.confusion(p)
    assert evaluate.accuracy(m).first().accuracy == 40
    by = {r.tag: r for r in evaluate.by_tag(m).collect()}
    assert round(by["NOUN"].recall, 1) == 33.3 and by["NOUN"].precision == 50 and by["VERB"].recall == 50
    assert evaluate.one_to_one(m) == {"NOUN": "VERB", "VERB": "NOUN"}
    g, t = aln(spark, [(1, 1), (2, 2)]), aln(spark, [(1, 1), (2, 3), (3, 3)])
    from pyspark.sql import functions as F

    n = evaluate.alignment_counts(g, t.withColumn("m", F.lit("x")), K, ["m"]).withColumn("gold", F.lit(2))
    assert round(evaluate.alignment_scores(n).first().aer, 4) == 0.6
