"""The pipeline's near duplicates against all pairs."""

import random

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_first_of_near_duplicates(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(2000)}" for _ in range(rng.randint(80, 200))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for changes in (1, 2, 3, 6):
            c = list(b)
            for _ in range(changes):
                c[rng.randrange(len(c))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(c))
    texts += texts[:3] + [None, "", " ", "one", "One", "two words"]
    rows = list(enumerate(texts))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.first_of_near_duplicates(spark, df.union(df.limit(2)), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))})
    assert corpus_pipeline.first_of_near_duplicates(spark, df.filter("false"), "").count() == 0


def removed(spark, texts, **block):
    """Rows that the stage removes, and those of a comparison of all pairs."""
    from glosspark.llm import shingles as module

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in module.keep_first(df).collect()}
    want = {find(i) for i in range(len(texts))}
    assert want <= kept  # no link below the threshold
    return len(texts) - len(kept), len(texts) - len(want)


def group(seed, n, words, changes):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    for _ in range(n):
        c = list(base)
        for _ in range(changes):
            c[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        yield " ".join(c)


def test_large_groups(spark, monkeypatch):
    """Groups of near copies most of which are just too unlike to be linked."""
    from glosspark.llm import shingles as module

    got, want = removed(spark, list(group(1, 700, 100, 2)))
    assert got >= 0.98 * want and want > 100
    monkeypatch.setattr(module, "BLOCK_BYTES", 100_000)  # several blocks
    got, want = removed(spark, [*group(2, 400, 150, 3), *group(3, 200, 150, 1), *("x y z " * k for k in range(3))])
    assert got >= 0.98 * want and want > 200


def test_forest():
    import numpy as np

    from glosspark.llm import shingles as module

    sets_of = [np.arange(100), np.arange(5, 100), np.arange(1000, 1100), np.arange(2, 100), np.arange(40)]
    sign = np.zeros((5, 120), np.uint8)
    sign[2] = 1
    every = np.arange(5)
    assert len(module.linked(sign, sets_of, every, every)) == 2  # 0, 1 and 3; 4 is too small
    assert module.linked(sign, sets_of, np.array([0, 1]), np.array([2, 4])) == []
    assert module.linked(sign, sets_of, np.array([0]), np.array([3])) == [(0, 3)]


def test_texts_are_dealt_out_once(spark):
    """One exchange of the texts for the rows that stay; null ids and repeated rows as before."""
    from glosspark.llm import shingles as module

    texts = ["a b c d e f g", "a b c d e f g", None, "", "h i j k l m n", "h i j k l m n"]
    df = spark.createDataFrame(list(zip([None, 3, 5, None, None, None], texts)), "doc_id long, text string")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = module.keep_first(df.union(df))
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("3", "a b c d e f g"), ("5", None), ("None", "h i j k l m n")]
    lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    first = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x or "BroadcastHashJoin" in x)
    assert not any("Exchange" in x for x in lines[:first])


def test_shuffle_files_go(spark):
    """The stage leaves no shuffle files of its steps, and the session's setting as it was."""
    import glob

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, base = spark.conf.get(key, None), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(x) for x in base.localDirsString()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    df = spark.createDataFrame(list(enumerate(group(5, 60, 100, 1))), "doc_id long, text string").repartition(3)
    df.write.format("noop").mode("overwrite").save()
    before = files()
    out = corpus_pipeline.first_of_near_duplicates(spark, df, "")
    assert not files() - before
    assert out.count() < 60 and spark.conf.get(key, None) == had
