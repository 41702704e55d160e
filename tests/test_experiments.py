"""Grids of settings and their store."""

from glosspark.plans import experiments

KEYS = ["igt_id"]


def tokens(spark, rows):
    return spark.createDataFrame([(i, k, w, t) for i, ws in rows.items() for k, (w, t) in enumerate(ws, 1)], "igt_id long, idx int, tok string, label string")


def test_heuristic_grid_goes_on_where_it_stopped(spark, tmp_path):
    src = tokens(spark, {1: [("dog", "N"), ("run", "V"), ("3SG", "X")], 2: [("cat", "N")]})
    tgt = tokens(spark, {1: [("the", "D"), ("dog", "N"), ("runs", "V")], 2: [("a", "D"), ("feline", "N")]})
    gold = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 2)], "igt_id long, src int, tgt int")
    store = experiments.Store(spark, str(tmp_path / "store"))
    assert store.results().count() == 0 and store.last_size("a") is None
    first = experiments.heuristic_grid(store, "a", src, tgt, gold, KEYS, {"exact": {"stem": False, "gram": False}})
    assert [(r.setting, r.matches, r.compares, r.precision, r.recall) for r in first.collect()] == [("exact", 1, 1, 1.0, 1 / 3)]
    got = {r.setting: (r.matches, r.compares) for r in experiments.heuristic_grid(store, "a", src, tgt, gold, KEYS).collect()}
    assert got.keys() == experiments.HEURISTICS.keys() and len(got) == 7
    assert got["exact"] == (1, 1) and got["stem"] == (2, 2) and got["all_pos"] == (3, 3)
    assert store.results().filter("setting = 'exact'").count() == 1  # was there already
    assert {r.run for r in store.runs().collect()} == {"a"} and store.last_size("a") == 4 and store.seen("a", "gram") and not store.seen("b", "gram")
    plain = experiments.heuristic_grid(store, "b", src.drop("label"), tgt, gold, KEYS, {"stem": {"gram": False}, "all_pos": {"pos": True}})
    assert [r.setting for r in plain.collect()] == ["stem"]


def test_feature_grid(spark, tmp_path):
    rows = {i: [(f"{'abc'[i % 3]}o{i}ing", "VERB"), (f"{'abc'[i % 3]}u{i}er", "NOUN"), ("foc", "PRT")] for i in range(24)}
    taught, tested = tokens(spark, {i: r for i, r in rows.items() if i % 2}), tokens(spark, {i: r for i, r in rows.items() if not i % 2})
    some = {k: experiments.ABLATION[k] for k in ("suffix", "basic")}
    got = {r.setting: r for r in experiments.feature_grid(experiments.Store(spark, str(tmp_path / "s")), "f", taught, tested, KEYS, settings=some).collect()}
    assert got["suffix"].precision == 1.0 and got["basic"].precision < 1.0 and got["basic"].compares == 36
    assert len(experiments.ABLATION) == 10


def test_projected_or_classified(spark):
    tags = lambda rows: spark.createDataFrame(rows, "igt_id long, idx int, label string")
    got = {r.method: (r.matches, r.compares, r.recall) for r in experiments.projected_or_classified(tags([(1, 1, "N")]), tags([(1, 1, "V"), (1, 2, "V"), (9, 9, "N")]), tags([(1, 1, "N"), (1, 2, "V")]), KEYS).collect()}
    assert got == {"projection": (1, 1, 0.5), "classifier": (1, 2, 0.5)}
