"""Alignment with fertilities and absolute distortion (IBM Model 3), trained by sampled expectation maximisation.

A model is four tables: ``t(e, f, t)`` translations, ``n(e, phi, p)`` fertilities, ``d(l, m, i, j, p)`` places of a target word given
its source's place and both lengths, and ``p1``, the chance that a word is followed by one from NULL. The E-step works sentence pair by
sentence pair in Arrow batches: from the best links by themselves a pair climbs by moves (one word to another source) and swaps (two words
exchange sources) to a peak, and takes expectations over the peak and all that is one move or swap away. A pair with at most ``ENUMERATED``
alignments is summed over all of them instead, which is exact. Only sums of counts are shuffled; each
iteration's tables are cut from their lineage in the shared folder.

Pairs with an empty side give no counts. Words without an entry count with ``FLOOR``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators.em import NULL, hmm, ibm1, sentence_pairs, viterbi_hmm
from glosspark.session import cut, ship

FLOOR = 1e-7
ENUMERATED = 512
TABLES = {"t": "e string, f string, t double", "n": "e string, phi int, p double", "d": "l int, m int, i int, j int, p double"}
COUNTS = "kind string, e string, f string, l int, m int, i int, j int, c double"
_FACTORIALS = [0.0]


def log_factorial(k: int) -> float:
    while len(_FACTORIALS) <= k:
        _FACTORIALS.append(_FACTORIALS[-1] + math.log(len(_FACTORIALS)))
    return _FACTORIALS[k]


@dataclass
class Model:
    """The tables and p1; ``save`` and ``load`` keep them as Parquet in a folder that training resumes from."""

    t: DataFrame
    n: DataFrame
    d: DataFrame
    p1: float

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.t.sparkSession.createDataFrame([(self.p1,)], "p1 double").write.parquet(f"{path}/p1")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(*(spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in TABLES.items()), spark.read.parquet(f"{path}/p1").first().p1)


class Pair:
    """One sentence pair under a model: scores of links and fertilities, with source 0 for NULL."""

    def __init__(self, e: list[str], f: list[str], t: dict, n: dict, d: dict, p1: float):
        self.l, self.m = len(e), len(f)
        self.e, self.f = [NULL, *e], f
        with np.errstate(divide="ignore"):
            self.link = np.log([[max(t.get((w, x), 0.0), FLOOR) for x in f] for w in self.e])
            self.link[1:] += np.log([[max(d.get((i, j), 0.0), FLOOR) for j in range(1, self.m + 1)] for i in range(1, self.l + 1)])
        born = np.array([[max(n.get((w, k), 0.0), FLOOR) for k in range(self.m + 2)] for w in e])
        self.born = np.log(born) + np.array([log_factorial(k) for k in range(self.m + 2)])
        p1 = min(max(p1, 1e-9), 1 - 1e-9)
        self.null = np.full(self.m + 2, -np.inf)
        for k in range(self.m // 2 + 1):
            self.null[k] = log_factorial(self.m - k) - log_factorial(k) - log_factorial(self.m - 2 * k) + (self.m - 2 * k) * math.log(1 - p1) + k * math.log(p1)

    def fertility(self, a: np.ndarray) -> np.ndarray:
        return np.bincount(a, minlength=self.l + 1)

    def score(self, a: np.ndarray) -> float:
        phi = self.fertility(a)
        return float(self.null[phi[0]] + self.born[np.arange(self.l), phi[1:]].sum() + self.link[a, np.arange(self.m)].sum())

    def moves(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gains of all moves (word, source), and of all swaps (word, later word); -inf for what changes nothing."""
        phi, at = self.fertility(a), np.arange(self.m)
        own = self.link[a, at]
        table = np.vstack([self.null, self.born])
        i = np.arange(self.l + 1)
        with np.errstate(invalid="ignore"):
            lose = table[i, np.maximum(phi - 1, 0)] - table[i, phi]
            gain = table[i, phi + 1] - table[i, phi]
        move = self.link.T - own[:, None] + lose[a][:, None] + gain[None, :]
        move[at, a] = -np.inf
        crossed = self.link[a][:, at]  # [k, j]: word j under word k's source
        swap = crossed + crossed.T - own[:, None] - own[None, :]
        swap[(a[:, None] == a[None, :]) | (at[:, None] >= at[None, :])] = -np.inf
        return move, swap

    def peak(self) -> np.ndarray:
        """Climb from the best links, NULL links in excess given up where that costs least."""
        a = self.link.argmax(0)
        while (a == 0).sum() > self.m // 2:
            loss = self.link[1:].max(0) - self.link[0]
            j = int(np.where(a == 0, loss, -np.inf).argmax())
            a[j] = 1 + int(self.link[1:, j].argmax())
        while True:
            move, swap = self.moves(a)
            best, other = float(move.max()), float(swap.max())
            if max(best, other) <= 1e-9:
                return a
            if best >= other:
                j, i = divmod(int(move.argmax()), self.l + 1)
                a[j] = i
            else:
                j, k = divmod(int(swap.argmax()), self.m)
                a[j], a[k] = a[k], a[j]

    def enumerated(self) -> tuple[np.ndarray, np.ndarray]:
        """All alignments, a row each, and their scores."""
        every = np.indices([self.l + 1] * self.m).reshape(self.m, -1).T
        phi = (every[:, :, None] == np.arange(self.l + 1)).sum(1)
        return every, self.null[phi[:, 0]] + self.born[np.arange(self.l), phi[:, 1:]].sum(1) + self.link[every, np.arange(self.m)].sum(1)

    def exact(self) -> bool:
        return (self.l + 1) ** self.m <= ENUMERATED

    def best(self) -> np.ndarray:
        if self.exact():
            every, scores = self.enumerated()
            return every[int(scores.argmax())]
        return self.peak()

    def expected(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected links [source, word], expected cases of each fertility [source, count], and the log likelihood."""
        links, born = np.zeros((self.l + 1, self.m)), np.zeros((self.l + 1, self.m + 2))
        rows, at = np.arange(self.l + 1), np.arange(self.m)
        if self.exact():
            every, scores = self.enumerated()
            top = scores.max()
            w = np.exp(scores - top)
            total = float(w.sum())
            for j in at:
                links[:, j] = np.bincount(every[:, j], w, self.l + 1)
            for i in rows:
                born[i] = np.bincount((every == i).sum(1), w, self.m + 2)
        else:
            a = self.peak()
            top = self.score(a)
            move, swap = (np.exp(x) for x in self.moves(a))
            total = 1 + float(move.sum() + swap.sum())
            links += move.T
            both = swap + swap.T
            for j in at:  # word j goes to the source of the word that it changes places with
                links[:, j] += np.bincount(a, both[j], self.l + 1)
            links[a, at] += total - move.sum(1) - both.sum(1)
            phi = self.fertility(a)
            out, into = np.bincount(a, move.sum(1), self.l + 1), move.sum(0)
            born[rows, phi] += total - out - into
            born[rows, phi + 1] += into
            had = phi > 0
            born[rows[had], phi[had] - 1] += out[had]
        return links / total, born / total, float(top) + math.log(total)


def _pairs(bitext: DataFrame, model: Model) -> DataFrame:
    """One row per pair with its words and all that the model has for them."""
    ship(bitext.sparkSession)
    words = bitext.groupBy("pair").agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "tok")))), lambda x: x["tok"]).alias(s) for s in "ef"))
    words = words.filter("size(e) > 0 AND size(f) > 0").withColumn("l", F.size("e")).withColumn("m", F.size("f"))
    t = sentence_pairs(bitext).join(model.t, ["e", "f"]).groupBy("pair").agg(F.collect_list(F.struct("e", "f", "t")).alias("ts"))
    types = bitext.filter("side = 'e'").select("pair", F.col("tok").alias("e")).distinct()
    n = types.join(model.n, "e").groupBy("pair").agg(F.collect_list(F.struct("e", "phi", "p")).alias("ns"))
    d = model.d.groupBy("l", "m").agg(F.collect_list(F.struct("i", "j", "p")).alias("ds"))
    return words.join(t, "pair", "left").join(n, "pair", "left").join(d, ["l", "m"], "left").select("pair", "e", "f", "ts", "ns", "ds")


def _each(batch, p1: float):
    lists = lambda x: [] if x is None else x
    for pair, e, f, ts, ns, ds in zip(batch.pair, batch.e, batch.f, batch.ts, batch.ns, batch.ds):
        t, n, d = {(x["e"], x["f"]): x["t"] for x in lists(ts)}, {(x["e"], x["phi"]): x["p"] for x in lists(ns)}, {(x["i"], x["j"]): x["p"] for x in lists(ds)}
        yield pair, Pair(list(e), list(f), t, n, d, p1)


def _counts(bitext: DataFrame, model: Model) -> DataFrame:
    """Sums of expected counts: t by (e, f), n by (e, i = fertility), d by (l, m, i, j), 0 and 1 for words without and with a NULL word, h for the log likelihood."""
    p1 = model.p1

    def run(batches):
        import pandas as pd

        for batch in batches:
            sums: dict[tuple, float] = defaultdict(float)
            for _, x in _each(batch, p1):
                links, born, h = x.expected()
                sums["h", "", "", 0, 0, 0, 0] += h
                nulls = float((born[0] * np.arange(x.m + 2)).sum())
                sums["1", "", "", 0, 0, 0, 0] += nulls
                sums["0", "", "", 0, 0, 0, 0] += x.m - 2 * nulls
                for i, j in zip(*np.nonzero(links > 1e-9)):
                    c = float(links[i, j])
                    sums["t", x.e[i], x.f[j], 0, 0, 0, 0] += c
                    if i:
                        sums["d", "", "", x.l, x.m, int(i), int(j) + 1] += c
                for i, k in zip(*np.nonzero(born[1:] > 1e-9)):
                    sums["n", x.e[i + 1], "", 0, 0, int(k), 0] += float(born[i + 1, k])
            yield pd.DataFrame([(*k, c) for k, c in sums.items()], columns=["kind", "e", "f", "l", "m", "i", "j", "c"])

    found = _pairs(bitext, model).mapInPandas(run, COUNTS)
    return found.groupBy("kind", "e", "f", "l", "m", "i", "j").agg(F.sum("c").alias("c"))


def _share(counts: DataFrame, by: list[str], rest: list[str], name: str) -> DataFrame:
    return counts.join(counts.groupBy(*by).agg(F.sum("c").alias("s")), by).select(*by, *rest, (F.col("c") / F.col("s")).alias(name))


def step(bitext: DataFrame, model: Model) -> tuple[Model, float]:
    """One iteration: the model that the expectations under ``model`` give, and the perplexity of the f side under ``model``."""
    found = cut(_counts(bitext, model))
    t = cut(_share(found.filter("kind = 't'").select("e", "f", "c"), ["e"], ["f"], "t"))
    n = cut(_share(found.filter("kind = 'n'").select("e", F.col("i").alias("phi"), "c"), ["e"], ["phi"], "p"))
    d = cut(_share(found.filter("kind = 'd'").select("l", "m", "i", "j", "c"), ["l", "m", "i"], ["j"], "p"))
    whole = {r.kind: r.c for r in found.filter("kind IN ('0', '1', 'h')").select("kind", "c").collect()}  # three numbers
    ones = whole.get("1", 0.0)
    p1 = ones / ((whole.get("0", 0.0) + ones) or 1.0)
    return Model(t, n, d, p1), _perplexity(bitext, whole.get("h", 0.0))


def _perplexity(bitext: DataFrame, log_likelihood: float) -> float:
    full = bitext.groupBy("pair").agg(F.count_if(F.col("side") == "e").alias("l"), F.count_if(F.col("side") == "f").alias("m")).filter("l > 0")
    return math.exp(-log_likelihood / (full.agg(F.sum("m")).first()[0] or 1))


def perplexity(bitext: DataFrame, model: Model) -> float:
    """e to the cross entropy of the f side; climbed pairs count only what lies about their peaks, so it is an upper bound."""
    h = _counts(bitext, model).filter("kind = 'h'").first()
    return _perplexity(bitext, h.c if h else 0.0)


def from_links(bitext: DataFrame, t: DataFrame, links: DataFrame, weight: float = 0.1) -> Model:
    """A first model from a translation table and links ``(pair, src, tgt)``, counts of fertilities and places smoothed by ``weight``."""
    size = bitext.groupBy("pair").agg(F.count_if(F.col("side") == "e").cast("int").alias("l"), F.count_if(F.col("side") == "f").cast("int").alias("m")).filter("l > 0 AND m > 0")
    held = links.join(size, "pair")
    e = bitext.filter("side = 'e'").select("pair", F.col("idx").alias("src"), F.col("tok").alias("e")).join(size, "pair")
    phi = e.join(held.groupBy("pair", "src").agg(F.count("*").cast("int").alias("phi")), ["pair", "src"], "left").select("e", F.coalesce("phi", F.lit(0)).alias("phi"), F.lit(1.0).alias("c"))
    few = e.select("e").distinct().select("e", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("phi"), F.lit(weight).alias("c"))
    n = _share(phi.unionByName(few).groupBy("e", "phi").agg(F.sum("c").alias("c")), ["e"], ["phi"], "p")
    seen = held.filter("src > 0").select("l", "m", F.col("src").cast("int").alias("i"), F.col("tgt").cast("int").alias("j"), F.lit(1.0).alias("c"))
    flat = size.select("l", "m").distinct().select("l", "m", F.explode(F.sequence(F.lit(1), "l")).alias("i")).select("l", "m", "i", F.explode(F.sequence(F.lit(1), "m")).alias("j"), F.lit(weight).alias("c"))
    d = _share(seen.unionByName(flat).groupBy("l", "m", "i", "j").agg(F.sum("c").alias("c")), ["l", "m", "i"], ["j"], "p")
    words = size.agg(F.sum("m").alias("m")).first().m or 1
    linked = held.filter("src > 0").count()
    nulls = words - linked
    return Model(cut(t), cut(n), cut(d), min(max(nulls / max(linked, 1), 0.01), 0.5))


def train(bitext: DataFrame, iterations: int = 5, start: Model | None = None, first: int = 5, hmm_iterations: int = 5) -> tuple[Model, list[float]]:
    """A model and the perplexity before each iteration; without ``start`` Model 1 and the HMM are trained first and hand over their links."""
    if start is None:
        table, jumps = hmm(bitext, ibm1(bitext, first), hmm_iterations)
        start = from_links(bitext, table, viterbi_hmm(bitext, table, jumps))
    model, seen = start, []
    for _ in range(iterations):
        model, now = step(bitext, model)
        seen.append(now)
    return model, seen


def resume(bitext: DataFrame, path: str, iterations: int = 5) -> tuple[Model, list[float]]:
    """Further iterations from stored tables."""
    return train(bitext, iterations, Model.load(bitext.sparkSession, path))


def viterbi(bitext: DataFrame, model: Model) -> DataFrame:
    """(pair, src, tgt): each f token's e token, 0 for NULL, at the peak."""
    p1 = model.p1

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(pair, int(i), j) for pair, x in _each(batch, p1) for j, i in enumerate(x.best(), 1)]
            yield pd.DataFrame(rows, columns=["pair", "src", "tgt"])

    kind = bitext.schema["pair"].dataType.simpleString()
    return _pairs(bitext, model).mapInPandas(run, f"pair {kind}, src int, tgt int")


def hmm_perplexity(bitext: DataFrame, table: DataFrame, jumps: list[float], width: int = 8, p_null: float = 0.2) -> float:
    """e to the cross entropy of the f side under the HMM, to compare with."""
    from glosspark.operators.em import _sentences, lattice, token_lists

    def run(batches):
        import pandas as pd

        for batch in batches:
            h = 0.0
            for e, f, entries in zip(batch.e, batch.f, batch.entries):
                if len(e) and len(f):
                    emit, move, start = lattice(list(e), list(f), {(x["e"], x["f"]): x["t"] for x in entries}, jumps, width, p_null)
                    now = start * emit[:, 0]
                    for j in range(1, len(f)):
                        h += math.log(now.sum())
                        now = (now / now.sum()) @ move * emit[:, j]
                    h += math.log(now.sum())
            yield pd.DataFrame({"h": [h]})

    return _perplexity(bitext, _sentences(token_lists(bitext), table).mapInPandas(run, "h double").agg(F.sum("h")).first()[0] or 0.0)
