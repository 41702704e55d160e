"""Running totals over ranges: null sizes, and columns of any name."""

import itertools
import random

from glosspark.operators import corpus

NAMES = ["upto", "part", "chunk", "_p", "_n", "_t", "p", "t", "row", "size", "total", "before", "own", "whole", "o0"]


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0, 1, 5, 9])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    return sorted(rows), df.selectExpr("*", *(f"concat(id, ':{c}') AS `{c}`" for c in NAMES))


def same(r, *but):
    return all(r[c] == f"{r.id}:{c}" for c in NAMES if c not in but)


def test_running(spark):
    rows, df = table(spark, 900)
    got = {r.id: r for r in corpus.running(df, ["id"]).collect()}
    for (i, n), total in zip(rows, itertools.accumulate(x or 0 for _, x in rows)):
        assert (got[i].n, got[i].upto) == (n, total) and same(got[i], "upto")


def test_split_share_and_chunks(spark):
    rows, df = table(spark, 500, 2)
    total = sum(n or 0 for _, n in rows)
    got = {r.id: r for r in corpus.split(df, ["id"]).collect()}
    for (i, _), upto in zip(rows, itertools.accumulate(x or 0 for _, x in rows)):
        assert got[i].part == ("train" if upto < round(0.8 * total) else "dev" if upto < round(0.9 * total) else "test") and same(got[i], "upto", "part")
    share = corpus.first_share(df, ["id"], 0.3).collect()
    assert sorted(r.id for r in share) == list(range(150)) and all(same(r) for r in share) and share[0].asDict().keys() == set(df.columns)
    chunks = corpus.chunks(df, ["id"], 7).collect()
    assert all(r.chunk == min(r.id * 7 // 500, 6) and same(r, "chunk") for r in chunks) and len(chunks) == 500
    assert corpus.chunks(df.filter("false"), ["id"], 7).count() == 0 == corpus.split(df.filter("false"), ["id"]).count()
