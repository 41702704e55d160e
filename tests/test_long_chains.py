"""Chains longer than any fixed number of levels."""

from glosspark.operators import search, trees


def test_depths_of_a_long_chain(spark):
    e = spark.createDataFrame([(1, i, i - 1) for i in range(1, 68)], "k int, dep int, head int").coalesce(1)
    assert {(r.dep, r.depth) for r in trees.depths(e, ["k"]).collect()} == {(i, i) for i in range(1, 68)}


def test_follow_a_long_chain(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(20)] + [(2, 0, 1), (2, 1, 0)], "k int, item int, target int").coalesce(1)
    want = {(1, i, j) for i in range(20) for j in range(i + 1, 21)} | {(2, a, b) for a in (0, 1) for b in (0, 1)}
    assert {tuple(r) for r in search.follow(links, ["k"]).collect()} == want
