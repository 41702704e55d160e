"""The fertility model against enumeration of all alignments."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from glosspark.operators import em, fertility

NULL = "NULL"
PAIRS = {1: ("red box", "rote kiste"), 2: ("red", "rote"), 3: ("small box here", "hier kiste kleine"), 4: ("small red box", "kleine rote kiste"), 5: ("here here", "hier"), 6: ("", "kiste"), 7: ("box", ""), 8: ("red box", "die rote kiste da")}


def texts():
    return {k: (e.split(), f.split()) for k, (e, f) in PAIRS.items()}


def bitext(spark, pairs=None):
    rows = [(k, side, i, w) for k, both in (pairs or texts()).items() for side, ws in zip("ef", both) for i, w in enumerate(ws, 1)]
    return spark.createDataFrame(rows, "pair long, side string, idx int, tok string")


def weight(e, f, a, t, n, d, p1):
    """The probability of f and the alignment a, factor by factor."""
    floor = fertility.FLOOR
    l, m = len(e), len(f)
    phi = collections.Counter(a)
    if 2 * phi[0] > m:
        return 0.0
    p = math.comb(m - phi[0], phi[0]) * p1 ** phi[0] * (1 - p1) ** (m - 2 * phi[0])
    for i in range(1, l + 1):
        p *= math.factorial(phi[i]) * max(n.get((e[i - 1], phi[i]), 0), floor)
    for j, i in enumerate(a, 1):
        p *= max(t.get(((NULL, *e)[i], f[j - 1]), 0), floor)
        if i:
            p *= max(d.get((l, m, i, j), 0), floor)
    return p


def iterate(pairs, t, n, d, p1):
    """Expectation maximisation over every alignment."""
    ct, cn, cd, zeros, ones, h = collections.Counter(), collections.Counter(), collections.Counter(), 0.0, 0.0, 0.0
    for e, f in pairs.values():
        if not e or not f:
            continue
        every = list(itertools.product(range(len(e) + 1), repeat=len(f)))
        w = [weight(e, f, a, t, n, d, p1) for a in every]
        z = sum(w)
        h += math.log(z)
        for a, x in zip(every, w):
            phi = collections.Counter(a)
            zeros += x / z * (len(f) - 2 * phi[0])
            ones += x / z * phi[0]
            for i in range(1, len(e) + 1):
                cn[e[i - 1], phi[i]] += x / z
            for j, i in enumerate(a, 1):
                ct[(NULL, *e)[i], f[j - 1]] += x / z
                if i:
                    cd[len(e), len(f), i, j] += x / z

    def share(counts, by):
        total = collections.Counter()
        for k, c in counts.items():
            total[by(k)] += c
        return {k: c / total[by(k)] for k, c in counts.items()}

    words = sum(len(f) for e, f in pairs.values() if e)
    return share(ct, lambda k: k[0]), share(cn, lambda k: k[0]), share(cd, lambda k: k[:3]), ones / (zeros + ones), math.exp(-h / words)


def tables(model):
    t = {(r.e, r.f): r.t for r in model.t.collect()}
    n = {(r.e, r.phi): r.p for r in model.n.collect()}
    d = {(r.l, r.m, r.i, r.j): r.p for r in model.d.collect()}
    return t, n, d, model.p1


def close(got, want):
    return all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-7 for k in {*got, *want})


def first(spark, b):
    return fertility.from_links(b, em.ibm1(b, 2), em.viterbi1(b, em.ibm1(b, 2)))


def test_iterations_equal_enumeration(spark, tmp_path):
    """No pair here has over 81 alignments, so all are summed."""
    b = bitext(spark)
    model = first(spark, b)
    want = tables(model)
    for _ in range(3):
        model, seen = fertility.step(b, model)
        *want, perplexity = iterate(texts(), *want)
        assert all(close(g, w) for g, w in zip(tables(model)[:3], want[:3])) and abs(model.p1 - want[3]) < 1e-9 and abs(seen - perplexity) < 1e-6
    best = {}
    for k, (e, f) in texts().items():
        if e and f:
            every = list(itertools.product(range(len(e) + 1), repeat=len(f)))
            best[k] = every[int(np.argmax([weight(e, f, a, *want) for a in every]))]
    got = collections.defaultdict(dict)
    for r in fertility.viterbi(b, model).collect():
        got[r.pair][r.tgt] = r.src
    assert {k: tuple(v[j] for j in sorted(v)) for k, v in got.items()} == best
    model.save(str(tmp_path / "m"))
    more, seen = fertility.resume(b, str(tmp_path / "m"), 1)
    *want, perplexity = iterate(texts(), *want)
    assert close(tables(more)[0], want[0]) and abs(seen[0] - perplexity) < 1e-6
    assert abs(fertility.perplexity(b, more) - iterate(texts(), *want)[-1]) < 1e-6


def random_pair(rng, l, m):
    e, f = [f"e{rng.randint(0, 3)}" for _ in range(l)], [f"f{rng.randint(0, 4)}" for _ in range(m)]
    t = {(w, x): rng.random() for w in [NULL, *e] for x in f}
    n = {(w, k): rng.random() for w in e for k in range(m + 1)}
    d = {(i, j): rng.random() for i in range(1, l + 1) for j in range(1, m + 1)}
    return e, f, t, n, d


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_and_climbing(monkeypatch, seed):
    rng = random.Random(seed)
    l, m = rng.randint(1, 4), rng.randint(1, 6)
    e, f, t, n, d = random_pair(rng, l, m)
    p = fertility.Pair(e, f, t, n, d, 0.2)
    every, scores = p.enumerated()
    known = {tuple(a): s for a, s in zip(every.tolist(), scores)}
    for a, s in known.items():
        w = weight(e, f, a, t, n, {(l, m, i, j): x for (i, j), x in d.items()}, 0.2)
        assert abs(math.exp(s) - w) < 1e-9 * max(w, 1e-12) + 1e-300
    for a in rng.sample([a for a, s in known.items() if s > -math.inf], 5 if len(known) > 8 else 1):
        move, swap = p.moves(np.array(a))
        for j in range(m):
            for i in range(l + 1):
                b = (*a[:j], i, *a[j + 1 :])
                assert move[j, i] == -math.inf if b == a else abs(math.exp(move[j, i]) - math.exp(known[b] - known[a])) < 1e-6 * math.exp(max(0, known[b] - known[a]))
            for k in range(j + 1, m):
                b = list(a)
                b[j], b[k] = b[k], b[j]
                assert swap[j, k] == -math.inf if tuple(b) == a else abs(swap[j, k] - (known[tuple(b)] - known[a])) < 1e-6
    peak = tuple(p.peak().tolist())
    near = {tuple(peak)}
    move, swap = p.moves(np.array(peak))
    for j in range(m):
        near |= {(*peak[:j], i, *peak[j + 1 :]) for i in range(l + 1)}
        for k in range(j + 1, m):
            b = list(peak)
            b[j], b[k] = b[k], b[j]
            near.add(tuple(b))
    assert max(known[a] for a in near) <= known[peak] + 1e-6
    monkeypatch.setattr(fertility, "ENUMERATED", 0)
    links, born, h = p.expected()
    # a neighbour that is reached both by a move and by a swap counts once only in a set, so compare with the list of ways
    ways = [peak] + [(*peak[:j], i, *peak[j + 1 :]) for j in range(m) for i in range(l + 1) if i != peak[j]]
    for j, k in itertools.combinations(range(m), 2):
        if peak[j] != peak[k]:
            b = list(peak)
            b[j], b[k] = b[k], b[j]
            ways.append(tuple(b))
    z = sum(math.exp(known[a]) for a in ways)
    assert abs(h - math.log(z)) < 1e-9
    for i in range(l + 1):
        for j in range(m):
            assert abs(links[i, j] - sum(math.exp(known[a]) for a in ways if a[j] == i) / z) < 1e-9
        for k in range(m + 1):
            assert abs(born[i, k] - sum(math.exp(known[a]) for a in ways if a.count(i) == k) / z) < 1e-9


def test_perplexity_falls_below_the_hmm(spark):
    rng = random.Random(3)
    lexicon = {f"e{i}": f"f{i}" for i in range(30)}
    pairs = {}
    for k in range(400):
        e = [f"e{min(rng.randint(0, 29), rng.randint(0, 29))}" for _ in range(rng.randint(2, 7))]
        f = []
        for w in e:  # every third word has two words on the other side, every seventh none
            i = int(w[1:])
            f += [] if i % 7 == 6 else [lexicon[w], f"g{i}"] if i % 3 == 0 else [lexicon[w]]
        pairs[k] = (e, f or ["f0"])
    b = bitext(spark, pairs)
    table, jumps = em.hmm(b, em.ibm1(b, 5), 5)
    before = fertility.hmm_perplexity(b, table, jumps)
    model, seen = fertility.train(b, 4, fertility.from_links(b, table, em.viterbi_hmm(b, table, jumps)))
    assert seen[-1] < seen[0] and seen[-1] < before
    links = collections.defaultdict(dict)
    for r in fertility.viterbi(b, model).collect():
        links[r.pair][r.tgt] = r.src
    right = total = 0
    for k, (e, f) in pairs.items():
        for j, w in enumerate(f, 1):
            total += 1
            i = links[k][j]
            right += i > 0 and e[i - 1][1:] == w[1:]
    assert right / total > 0.9


def test_empty(spark):
    b = bitext(spark, {1: ([], ["a"]), 2: (["b"], [])})
    model = fertility.from_links(b, spark.createDataFrame([], fertility.TABLES["t"]), spark.createDataFrame([], "pair long, src int, tgt int"))
    assert fertility.viterbi(b, model).count() == 0
    assert fertility.step(b, model)[0].t.count() == 0
