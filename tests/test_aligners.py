"""The aligners' queries against expectation maximisation by enumeration of every alignment."""

import collections
import itertools
import math

from glosspark.plans.catalogue import QUERIES

PAIRS = {1: ("red box", "rote kiste"), 2: ("red", "rote"), 3: ("small box here", "hier kiste kleine"), 4: ("small red box", "kleine rote kiste"), 5: ("here here", "hier"), 6: ("", "kiste"), 7: ("box", "")}
NULL, WIDTH = "NULL", 8


def query(spark, tmp_path, name):
    rows = [(k, e, f) for k, (e, f) in PAIRS.items()]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = collections.defaultdict(dict)
    for r in QUERIES[name](spark, str(tmp_path)).collect():
        assert r.tgt not in got[r.pair]
        got[r.pair][r.tgt] = r.src
    return got


def normalised(counts):
    total = collections.Counter()
    for (e, _), c in counts.items():
        total[e] += c
    return {(e, f): c / total[e] for (e, f), c in counts.items()}


def texts():
    return {k: (e.split(), f.split()) for k, (e, f) in PAIRS.items()}


def model1(iterations):
    table = collections.defaultdict(lambda: 1.0)
    for _ in range(iterations):
        counts = collections.Counter()
        for es, fs in texts().values():
            for f in fs:
                z = sum(table[e, f] for e in [NULL, *es])
                for e in [NULL, *es]:
                    counts[e, f] += table[e, f] / z
        table = normalised(counts)
    return table


def weighted_paths(es, fs, table, jumps):
    """Every path of states with its weight; state (i, False) is word i, (i, True) NULL behind word i."""
    n = len(es)
    step = [[jumps[max(-WIDTH, min(WIDTH, j - i))] for j in range(n)] for i in range(n)]
    for path in itertools.product(itertools.product(range(n), (False, True)), repeat=len(fs)):
        p = 1.0
        for k, (i, null) in enumerate(path):
            if k == 0:
                p *= (0.2 if null else 0.8) / n
            elif null:
                p *= 0.2 * (path[k - 1][0] == i)
            else:
                p *= 0.8 * step[path[k - 1][0]][i] / sum(step[path[k - 1][0]])
            p *= table.get((NULL if null else es[i], fs[k]), 1e-12)
        if p > 0:
            yield path, p


def test_hmm(spark, tmp_path):
    got = query(spark, tmp_path, "hmm_viterbi")
    table, jumps = model1(5), {d: 1 / (2 * WIDTH + 1) for d in range(-WIDTH, WIDTH + 1)}
    both = {k: x for k, x in texts().items() if x[0] and x[1]}
    for _ in range(5):
        counts, moved = collections.Counter(), collections.Counter()
        for es, fs in both.values():
            paths = list(weighted_paths(es, fs, table, jumps))
            z = sum(p for _, p in paths)
            for path, p in paths:
                for (i, null), f in zip(path, fs):
                    counts[NULL if null else es[i], f] += p / z
                for (i, _), (j, null) in itertools.pairwise(path):
                    if not null:
                        moved[j - i] += p / z
        table = normalised(counts)
        total = sum(moved.values())
        jumps = {d: max(moved[d] / total, 1e-6) for d in jumps}
    assert set(got) == set(both)
    for k, (es, fs) in both.items():
        assert sorted(got[k]) == list(range(1, len(fs) + 1))
        scores = collections.defaultdict(float)
        for path, p in weighted_paths(es, fs, table, jumps):
            links = tuple(0 if null else i + 1 for i, null in path)
            scores[links] = max(scores[links], p)
        assert math.isclose(scores[tuple(got[k][t] for t in sorted(got[k]))], max(scores.values()), rel_tol=1e-6)


def test_diagonal(spark, tmp_path):
    got = query(spark, tmp_path, "diagonal_align")

    def weights(es, fs, j):
        near = [math.exp(-4.0 * abs(i / len(es) - j / len(fs))) for i in range(1, len(es) + 1)]
        return [(0, NULL, 0.08), *((i, e, 0.92 * w / sum(near)) for i, (e, w) in enumerate(zip(es, near), 1))]

    table = collections.defaultdict(lambda: 1.0)
    for _ in range(5):
        counts = collections.Counter()
        for es, fs in texts().values():
            for j, f in enumerate(fs, 1):
                z = sum(w * table[e, f] for _, e, w in weights(es, fs, j))
                for _, e, w in weights(es, fs, j):
                    counts[e, f] += w * table[e, f] / z
        table = normalised(counts)
    for k, (es, fs) in texts().items():
        for j, f in enumerate(fs, 1):
            scores = {i: w * table[e, f] for i, e, w in weights(es, fs, j)}
            assert math.isclose(scores[got[k].get(j, 0)], max(scores.values()), rel_tol=1e-6)
        assert set(got[k]) <= set(range(1, len(fs) + 1))
