"""Joins on the keys of instances are never broadcast, however small their sides look to the planner."""

import pytest
from pyspark.sql import functions as F

from glosspark.operators import align, project
from glosspark.plans import enrich

K = ["k"]


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def links(spark):
    return spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "k int, src int, tgt int")


def tokens(spark):
    return spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "k int, idx int, tok string")


def tags(spark):
    return spark.createDataFrame([(1, 1, "NOUN"), (2, 1, "VERB")], "k int, idx int, label string")


MADE = {
    "compose": lambda s: align.compose(links(s), links(s), K),
    "positional": lambda s: align.positional(tokens(s), tokens(s), K),
    "matched": lambda s: align.matched(tokens(s), tokens(s), K),
    "intersection": lambda s: align.intersection(links(s), links(s).filter("k = 1"), K),
    "difference": lambda s: align.difference(links(s), links(s).filter("k = 1"), K),
    "unaligned": lambda s: align.unaligned(tokens(s), links(s), "src", K),
    "word_pairs": lambda s: align.word_pairs(links(s), tokens(s), tokens(s), K),
    "by_precedence": lambda s: project.by_precedence(links(s), tags(s), K),
    "across": lambda s: project.across(links(s), tags(s), K, "UNK"),
    "through_glosses": lambda s: enrich.through_glosses(links(s).select(F.col("k").alias("igt_id"), "src", "tgt", F.lit("heur").alias("method")), tokens(s).select(F.col("k").alias("igt_id"), "idx", F.lit(1).alias("word_idx"))),
}


@pytest.mark.parametrize("name", MADE)
def test_no_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(MADE[name](spark))


def test_set_algebra_with_repeats_and_nulls(spark):
    a = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 3, None), (2, 1, 1)], "k int, src int, tgt int")
    b = spark.createDataFrame([(1, 1, 2), (1, 3, None), (3, 1, 1)], "k int, src int, tgt int")
    assert {tuple(r) for r in align.intersection(a, b, K).collect()} == {(1, 1, 2), (1, 3, None)}
    assert align.intersection(a, b, K).count() == 2
    assert [tuple(r) for r in align.difference(a, b, K).collect()] == [(2, 1, 1)]
