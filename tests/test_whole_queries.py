"""Queries that take whole inputs, against brute force on small tables."""

import itertools

from glosspark.plans.catalogue import QUERIES


def test_cooc(spark, tmp_path):
    turns = [("a b c d e b", "p q r s t"), ("e a z z", "t u"), ("y", "q " + " ".join(f"w{i}" for i in range(30))), ("k", "")]
    rows = [(c, 2 * k + i, role, text) for c in (1, 2) for k, pair in enumerate(turns[c - 1 :: 2]) for i, (role, text) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = [(a[3].split(), b[3].split()) for a, b in itertools.pairwise(rows) if a[2] == "user"]
    ids = [{w: i for i, w in enumerate(dict.fromkeys(w for pair in pairs for w in pair[side]), 2)} for side in (0, 1)]
    want = {(ids[0][e], ids[1][f]) for es, fs in pairs for e in es for f in fs} | {(0, i) for i in ids[1].values()}
    got = QUERIES["cooc"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_data_curve(spark, tmp_path):
    n = 40027  # enough that ranges are dealt by a sample
    sizes = [i % 17 for i in range(n)]
    spark.range(n).selectExpr("id * 3 AS doc_id", "id % 17 AS n_chars").orderBy("n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    upto = [0, *itertools.accumulate(sizes)]
    want = {(k, min(k, n), upto[min(k, n)]) for k in range(50, n + 50, 50)}
    got = QUERIES["data_curve"](spark, str(tmp_path)).collect()
    assert {(r["size"], r.sentences, r.chars) for r in got} == want and len(got) == len(want)
