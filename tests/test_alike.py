"""Equal sentences are learnt from as one row with their number, and each still gets its own tags."""

from pyspark.sql import functions as F

from glosspark.operators import crf


def test_crf_counts_equal_sentences(spark):
    rows = [(s, i, [f"w={x}"], y) for s in range(12) for i, (x, y) in enumerate((("a", "A"), ("b", "B")) if s % 3 else (("b", "A"),))]
    tokens = spark.createDataFrame(rows, "k int, idx int, features array<string>, label string")
    assert crf._alike(crf.sentences(tokens, ["k"], ["A", "B"])).count() == 2
    model, seen = crf.train(tokens, ["k"], 3)
    one, seen_apart = crf.train(tokens.withColumn("features", F.array_append("features", F.concat(F.lit("k="), F.col("k").cast("string")))), ["k"], 1)
    assert abs(seen[0] - seen_apart[0]) < 1e-9  # without weights the likelihood is the same, equal or not
    out = crf.tag(tokens, ["k"], model)
    assert out.count() == tokens.count() and {tuple(r) for r in out.select("k", "idx").collect()} == {(s, i) for s, i, *_ in rows}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
