"""Phrase tiers as lists: the depth of a tree costs neither joins nor jobs, and odd tiers give what their tables give."""

import pytest

from glosspark.operators import tiers
from glosspark.plans import tree_queries

KEYS = ["k"]
ITEMS = "k int, idx int, item_id string, text string, alignment string, children string"
WORDS = "k int, idx int, item_id string, tok string"


def jobs(spark, run):
    """What ``run`` returns and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_long_turns_take_one_shuffle(spark, tmp_path):
    texts = ["\n".join(f"a{i} (b)\n \n" for i in range(n)) for n in (1, 40)] + ["", None, " \n"]
    spark.createDataFrame([(7, i, "user", x) for i, x in enumerate(texts)] + [(None, 9, "user", "c")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = tree_queries.phrase_tier_trees(spark, str(tmp_path))
    got, n = jobs(spark, df.collect)
    want = {(7, i): " ".join(f"(S (L (W{len(f'a{j}') % 5} a{j}) (W1 b))" for j in range(m)) + ")" * m for i, m in enumerate((1, 40))} | {(None, 9): "(S (L (W1 c)))"}
    assert {(r.conv_id, r.turn): r.tree for r in got} == want and len(got) == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert n <= 3 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ExistingRDD" not in plan


def test_deep_chain(spark):
    n = 3000
    rows = [(1, i, f"p{i}", "S", None, f"p{i + 1}") for i in range(1, n)] + [(1, n, f"p{n}", "N", "w1", "")]
    nodes = tiers.phrase_nodes(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([(1, 1, "w1", "x")], WORDS), KEYS)
    got, n_jobs = jobs(spark, lambda: nodes.orderBy("node").collect())
    assert [(r.node, r.parent, r.depth) for r in got] == [(i, i - 1 or None, i) for i in range(1, n + 1)]
    assert got[-1].word == "x" and n_jobs < 20


ODD = {
    "same id": [("a", "S", None, "b"), ("b", "N", "w1", None), ("b", "N", "w1", None)],
    "no id": [(None, "N", "w1", None)],
    "two words": [("a", "N", "w2", None)],
}


@pytest.mark.parametrize("problem", ODD)
def test_open_ids_are_problems(spark, problem):
    items = spark.createDataFrame([(1, i, *x) for i, x in enumerate(ODD[problem], 1)], ITEMS)
    words = spark.createDataFrame([(1, 1, "w1", "x"), (1, 2, "w2", "y"), (1, 3, "w2", "z")], WORDS)
    assert problem in {r.problem for r in tiers.phrase_problems(items, words, KEYS).collect()}
    assert tiers.phrase_nodes(items, words, KEYS).count() == 0


def test_a_ring_beside_the_root_hangs_nowhere(spark):
    items = spark.createDataFrame([(1, 1, "a", "S", None, "b"), (1, 2, "b", "N", "w1", None), (1, 3, "x", "X", None, "y"), (1, 4, "y", "Y", None, "x")], ITEMS)
    words = spark.createDataFrame([(1, 1, "w1", "t")], WORDS)
    assert [tuple(r) for r in tiers.phrase_nodes(items, words, KEYS).orderBy("node").collect()] == [(1, 1, None, 1, "S", 1, None, None), (1, 2, 1, 1, "N", 2, 1, "t")]
