"""The repeats of op8_lines are dealt by row once: repeats, islands and runs share that shuffle."""

from glosspark.llm import lines


def test_shuffles(spark):
    docs = spark.createDataFrame([(1, "one two three four\nfive six"), (2, "one two three four\nseven")], "doc_id long, text string")
    plan = lines.repeated_units(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3, plan
    assert {(r.doc_id, r.unit, r.start, r.stop) for r in lines.repeated_units(docs).collect()} == {(2, "line", 0, 18)}
