"""Statistical alignment: joins on pairs are never broadcast, and equal pairs count as often as they stand there."""

from pyspark.sql import functions as F

from glosspark.operators import em
from glosspark.plans import statistical
from tests.test_wide_joins import K, links, plan


def test_no_broadcast_statistical(spark):
    bitext = spark.createDataFrame([(1, "e", 1, "a"), (1, "f", 1, "x"), (2, "e", 1, "a"), (2, "f", 1, "y")], "pair int, side string, idx int, tok string")
    assert "BroadcastHashJoin" not in plan(em.sentence_pairs(bitext))
    layers = links(spark).select("k", "src", "tgt", F.lit("hmm").alias("method"))
    assert "BroadcastHashJoin" not in plan(statistical.preferred(layers, ["hmm"], K))


def test_hmm_counts_equal_pairs(spark):
    def bitext(times):
        rows = [(f"p{s}-{n}", side, i, t) for s, (e, f) in enumerate((("a b", "x y"), ("a", "x"), ("b a", "y x"))) for n in range(times) for side, ws in (("e", e), ("f", f)) for i, t in enumerate(ws.split(), 1)]
        return spark.createDataFrame(rows, "pair string, side string, idx int, tok string")

    assert em.alike(em.token_lists(bitext(4))).select("n").distinct().collect() == [(4,)]
    tables = []
    for b in (bitext(1), bitext(4)):
        t, jumps = em.hmm(b, em.ibm1(b, 3), 3)
        tables.append(({(r.e, r.f): round(r.t, 9) for r in t.collect()}, [round(x, 9) for x in jumps]))
    assert tables[0] == tables[1]
    links = em.viterbi_hmm(bitext(4), t, jumps)
    assert links.count() == 4 * 5 and links.select("pair").distinct().count() == 12
