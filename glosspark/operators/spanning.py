"""Dependency parsing by maximum spanning trees over scored edges.

``arcs(key.., dep, head, score)`` may hold any head of a word, 0 for the root; the best tree takes one head a word so that all hang from the
root and the sum is greatest (Chu and Liu, Edmonds: best heads, cycles contracted until none is left). ``parser`` learns scores: a table of
feature weights trained by a structured perceptron whose corrections are summed over all sentences and averaged over the rounds.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.session import cut, ship


def heads(score: np.ndarray) -> np.ndarray:
    """Heads of words 1.. under ``score[head, dep]`` over 0..n, -inf where there is no arc; heads[0] is 0. Of equal arcs the smallest head."""
    n = len(score)
    score = score.copy()
    score[:, 0] = -np.inf
    np.fill_diagonal(score, -np.inf)
    best = score.argmax(0)
    best[0] = 0
    cycle = _cycle(best)
    if not cycle:
        return best
    inside = np.zeros(n, bool)
    inside[cycle] = True
    outer = np.flatnonzero(~inside)  # 0 stays first
    # the cycle is one node, behind the others: an arc into it pays for the arc of the cycle that it replaces
    kept = score[best[cycle], cycle]
    into = score[np.ix_(outer, cycle)] - kept[None, :]
    out = score[np.ix_(cycle, outer)]
    small = np.full((len(outer) + 1,) * 2, -np.inf)
    small[:-1, :-1] = score[np.ix_(outer, outer)]
    small[:-1, -1], small[-1, :-1] = into.max(1), out.max(0)
    found = heads(small)
    result = best.copy()
    for k, dep in enumerate(outer):
        if k:
            result[dep] = cycle[int(out[:, k].argmax())] if found[k] == len(outer) else outer[found[k]]
    enter = found[-1]
    result[cycle[int(into[enter].argmax())]] = outer[enter]
    return result


def _cycle(head: np.ndarray) -> list[int]:
    """The nodes of a cycle, or none."""
    seen = np.zeros(len(head), int)
    for start in range(1, len(head)):
        at, path = start, []
        while at and not seen[at]:
            seen[at] = start
            path.append(at)
            at = int(head[at])
        if at and seen[at] == start:
            return sorted(path[path.index(at) :])
    return []


def matrix(words: list[int], arcs) -> np.ndarray:
    """Scores of arcs (dep, head, score) over the places of ``words``, the root first."""
    place = {0: 0} | {w: i for i, w in enumerate(words, 1)}
    out = np.full((len(words) + 1,) * 2, -np.inf)
    for dep, head, score in arcs:
        if dep in place and head in place and dep:
            out[place[head], place[dep]] = max(out[place[head], place[dep]], score)
    return out


def best_trees(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., dep, head, score)`` of each sentence's best tree; a sentence without a tree that holds every word has no row."""
    ship(arcs.sparkSession)
    sents = arcs.groupBy(*keys).agg(F.collect_list(F.struct("dep", "head", F.col("score").cast("double").alias("score"))).alias("arcs")).withColumn("sent", F.to_json(F.struct(*keys)))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for sent, found in zip(batch.sent, batch.arcs):
                own = [(x["dep"], x["head"], x["score"]) for x in found]
                words = sorted({x[0] for x in own})
                score = matrix(words, own)
                if reaches(score):
                    tree = heads(score)
                    rows += [(sent, w, ([0, *words])[tree[i]], float(score[tree[i], i])) for i, w in enumerate(words, 1)]
            yield pd.DataFrame(rows, columns=["sent", "dep", "head", "score"])

    found = sents.select("sent", "arcs").mapInPandas(run, "sent string, dep int, head int, score double")
    return found.join(sents.select("sent", *keys), "sent").select(*keys, "dep", "head", "score")


def reaches(score: np.ndarray) -> bool:
    """Whether all words can hang from the root."""
    seen = np.zeros(len(score), bool)
    seen[0] = True
    while True:
        more = seen | (score[seen] > -np.inf).any(0)
        if (more == seen).all():
            return bool(seen.all())
        seen = more


def arc_features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., dep, head, features)`` of every pair of words of ``tokens(key.., idx, tok, label)``, the root's word and label being ROOT."""
    dep = tokens.select(*keys, F.col("idx").alias("dep"), F.lower("tok").alias("w"), F.coalesce("label", F.lit("UNK")).alias("t"))
    root = tokens.select(*keys).distinct().select(*keys, F.lit(0).alias("head"), F.lit("ROOT").alias("hw"), F.lit("ROOT").alias("ht"))
    head = dep.select(*keys, F.col("dep").alias("head"), F.col("w").alias("hw"), F.col("t").alias("ht")).unionByName(root)
    far = F.col("dep") - F.col("head")
    way = F.concat(F.when(far > 0, "R").otherwise("L"), F.least(F.abs(far), F.lit(5)).cast("string"))
    names = F.array(*(F.concat_ws("|", F.lit(k), *parts) for k, parts in (("tt", ["ht", "t"]), ("ttd", ["ht", "t", way]), ("ww", ["hw", "w"]), ("wt", ["hw", "t"]), ("tw", ["ht", "w"]), ("td", ["t", way]))))
    return dep.join(head, keys).filter("dep <> head").select(*keys, "dep", "head", names.alias("features"))


def _corrections(sents: DataFrame, weights: DataFrame) -> DataFrame:
    """``(feature, g)``: features of the true trees less those of the best trees under ``weights``."""
    cells = sents.select("sent", F.explode(F.array_distinct(F.flatten(F.transform("arcs", lambda x: x["features"])))).alias("feature"))
    held = cells.join(weights, "feature").groupBy("sent").agg(F.collect_list(F.struct("feature", "w")).alias("ws"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            sums: dict[str, float] = defaultdict(float)
            for arcs, ws in zip(batch.arcs, batch.ws):
                known = {x["feature"]: x["w"] for x in (ws if ws is not None else ())}
                names = {(x["dep"], x["head"]): x["features"] for x in arcs}
                words = sorted({x["dep"] for x in arcs})
                tree = heads(matrix(words, [(d, h, sum(known.get(f, 0.0) for f in fs)) for (d, h), fs in names.items()]))
                guess = {w: ([0, *words])[tree[i]] for i, w in enumerate(words, 1)}
                for x in arcs:
                    change = int(x["true"]) - int(guess[x["dep"]] == x["head"])
                    if change:
                        for f in x["features"]:
                            sums[f] += change
            yield pd.DataFrame(list(sums.items()), columns=["feature", "g"])

    found = sents.join(held, "sent", "left").select("arcs", "ws").mapInPandas(run, "feature string, g double")
    return found.groupBy("feature").agg(F.sum("g").alias("g"))


def parser(arcs: DataFrame, trees: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """Weights ``(feature, w)`` from ``arcs`` (``arc_features``) and true ``trees(key.., dep, head)``, averaged over the rounds."""
    ship(arcs.sparkSession)
    true = trees.select(*keys, "dep", "head").distinct().withColumn("true", F.lit(True))
    marked = arcs.join(true, [*keys, "dep", "head"], "left").withColumn("true", F.coalesce("true", F.lit(False)))
    sents = cut(marked.groupBy(*keys).agg(F.collect_list(F.struct("dep", "head", "features", "true")).alias("arcs")).select(F.to_json(F.struct(*keys)).alias("sent"), "arcs"))
    now = cut(sents.select(F.explode(F.array_distinct(F.flatten(F.transform("arcs", lambda x: x["features"])))).alias("feature")).distinct().select("feature", F.lit(0.0).alias("w"), F.lit(0.0).alias("total")))
    for _ in range(rounds):
        moved = now.join(_corrections(sents, now.select("feature", "w")), "feature", "left").withColumn("w", F.col("w") + F.coalesce("g", F.lit(0.0)))
        now = cut(moved.select("feature", "w", (F.col("total") + F.col("w")).alias("total")))
    return now.select("feature", (F.col("total") / rounds).alias("w"))


def parse(arcs: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Best trees of sentences under learnt weights."""
    each = arcs.select(*keys, "dep", "head", F.explode("features").alias("feature")).join(weights, "feature", "left")
    return best_trees(each.groupBy(*keys, "dep", "head").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("score")), keys)
