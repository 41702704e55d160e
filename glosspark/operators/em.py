"""Statistical word alignment by expectation maximisation, as iterated joins and grouped sums.

``bitext(pair, side, idx, tok)`` has side ``e`` (conditioning) and ``f`` (generated). Each iteration's table is cut from its
lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.session import cut, ship, wide

NULL = "NULL"


def sentence_pairs(bitext: DataFrame) -> DataFrame:
    """(pair, e, f, n): how often f may come from e in a pair, NULL included."""
    e = bitext.filter("side = 'e'").select("pair", F.col("tok").alias("e"))
    e = e.union(bitext.select("pair").distinct().select("pair", F.lit(NULL).alias("e"))).groupBy("pair", "e").agg(F.count("*").alias("ne"))
    f = bitext.filter("side = 'f'").groupBy("pair", F.col("tok").alias("f")).agg(F.count("*").alias("nf"))
    return e.join(wide(f), "pair")


def token_lists(bitext: DataFrame) -> DataFrame:
    """(pair, e, f): both token lists of each pair."""
    return bitext.groupBy("pair").agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "tok")))), lambda x: x["tok"]).alias(s) for s in "ef"))


def alike(lists: DataFrame) -> DataFrame:
    """(pair, e, f, n): equal pairs as one row with their number, under the name of the first."""
    return lists.groupBy("e", "f").agg(F.min("pair").alias("pair"), F.count("*").alias("n"))


def spelled(each: DataFrame) -> DataFrame:
    """(pair, side, tok) of token lists."""
    rows = [each.select("pair", F.lit(s).alias("side"), F.explode(s).alias("tok")) for s in "ef"]
    return rows[0].unionByName(rows[1])


def ibm1(bitext: DataFrame, iterations: int = 5) -> DataFrame:
    """(e, f, t): IBM Model 1 translation probabilities from a uniform start."""
    each = cut(alike(token_lists(bitext)))
    cells = cut(sentence_pairs(spelled(each)).join(wide(each.select("pair", "n")), "pair"))
    table = cells.select("e", "f").distinct().withColumn("t", F.lit(1.0))
    for _ in range(iterations):
        seen = cells.join(table, ["e", "f"])
        norm = seen.groupBy("pair", "f").agg(F.sum(F.col("ne") * F.col("t")).alias("z"))
        share = seen.join(wide(norm), ["pair", "f"]).groupBy("e", "f").agg(F.sum(F.col("n") * F.col("nf") * F.col("ne") * F.col("t") / F.col("z")).alias("c"))
        total = share.groupBy("e").agg(F.sum("c").alias("s"))
        table = cut(share.join(total, "e").select("e", "f", (F.col("c") / F.col("s")).alias("t")))
    return table


def viterbi1(bitext: DataFrame, table: DataFrame) -> DataFrame:
    """(pair, src, tgt): each f token's best e token (0 for NULL, lowest index on ties)."""
    e = bitext.filter("side = 'e'").select("pair", F.col("idx").alias("src"), F.col("tok").alias("e"))
    e = e.union(bitext.select("pair").distinct().select("pair", F.lit(0).alias("src"), F.lit(NULL).alias("e")))
    f = bitext.filter("side = 'f'").select("pair", F.col("idx").alias("tgt"), F.col("tok").alias("f"))
    scored = e.join(wide(f), "pair").join(table, ["e", "f"])
    return scored.groupBy("pair", "tgt").agg(F.max_by("src", F.struct("t", -F.col("src"))).alias("src")).select("pair", "src", "tgt")


def perplexity(bitext: DataFrame, table: DataFrame) -> float:
    """2 to the cross entropy of the f side under Model 1."""
    e = bitext.filter("side = 'e'").groupBy("pair").agg((F.count("*") + 1).alias("l"))
    p = sentence_pairs(bitext).join(table, ["e", "f"]).groupBy("pair", "f", "nf").agg(F.sum(F.col("ne") * F.col("t")).alias("p")).join(e, "pair")
    row = p.agg(F.sum(F.col("nf") * F.log2(F.col("p") / F.col("l"))).alias("h"), F.sum("nf").alias("n")).first()
    return 2 ** (-row.h / row.n)


def hmm(bitext: DataFrame, table: DataFrame, iterations: int = 5, width: int = 8, p_null: float = 0.2) -> tuple[DataFrame, list[float]]:
    """HMM training from a Model 1 table: (e, f, t) and the jump distribution over -width..width.

    Forward and backward passes run pair by pair in Arrow groups (a pair is a sentence); only the expected counts are shuffled, and
    only the ``2 * width + 1`` jump sums reach the driver.
    """
    jumps = [1.0 / (2 * width + 1)] * (2 * width + 1)
    each = cut(alike(token_lists(bitext)))
    for _ in range(iterations):
        cells = _expected(each, table, jumps, width, p_null)
        cells = cut(cells)
        share = cells.filter("jump IS NULL").groupBy("e", "f").agg(F.sum("c").alias("c"))
        table = cut(share.join(share.groupBy("e").agg(F.sum("c").alias("s")), "e").select("e", "f", (F.col("c") / F.col("s")).alias("t")))
        sums = {r.jump: r.c for r in cells.filter("jump IS NOT NULL").groupBy("jump").agg(F.sum("c").alias("c")).collect()}
        total = sum(sums.values()) or 1.0
        jumps = [max(sums.get(d, 0.0) / total, 1e-6) for d in range(-width, width + 1)]
    return table, jumps


def _sentences(each: DataFrame, table: DataFrame) -> DataFrame:
    """Token lists with the table's entries for them."""
    ship(each.sparkSession)
    entries = sentence_pairs(spelled(each)).join(table, ["e", "f"]).groupBy("pair").agg(F.collect_list(F.struct("e", "f", "t")).alias("entries"))
    return each.join(wide(entries), "pair")


def lattice(e: list[str], f: list[str], entries: dict[tuple[str, str], float], jumps: list[float], width: int, p_null: float):
    """Emissions and transitions of one pair. States 0..n-1 are words; n..2n-1 are NULL reached from that word."""
    import numpy as np

    n = len(e)
    emit = np.array([[entries.get((w, x), 1e-12) for x in f] for w in e]).reshape(n, len(f))
    null = np.array([entries.get((NULL, x), 1e-12) for x in f])
    emit = np.vstack([emit, np.tile(null, (n, 1))])
    step = np.array([[jumps[min(max(j - i, -width), width) + width] for j in range(n)] for i in range(n)])
    step = step / step.sum(1, keepdims=True) * (1 - p_null)
    move = np.block([[step, np.eye(n) * p_null], [step, np.eye(n) * p_null]])
    start = np.concatenate([np.full(n, (1 - p_null) / n), np.full(n, p_null / n)])
    return emit, move, start


def _expected(each: DataFrame, table: DataFrame, jumps: list[float], width: int, p_null: float) -> DataFrame:
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for e, f, times, entries in zip(batch.e, batch.f, batch.n, batch.entries):
                e, f = list(e), list(f)
                if not e or not f:
                    continue
                emit, move, start = lattice(e, f, {(x["e"], x["f"]): x["t"] for x in entries}, jumps, width, p_null)
                m, n = len(f), len(e)
                forward, scale = np.zeros((m, 2 * n)), np.zeros(m)
                for j in range(m):
                    forward[j] = (start if j == 0 else forward[j - 1] @ move) * emit[:, j]
                    scale[j] = forward[j].sum()
                    forward[j] /= scale[j]
                back = np.ones((m, 2 * n))
                for j in range(m - 2, -1, -1):
                    back[j] = move @ (emit[:, j + 1] * back[j + 1]) / scale[j + 1]
                gamma = forward * back
                for j in range(m):
                    rows += [(w, f[j], None, times * g) for w, g in zip(e, gamma[j, :n].tolist()) if g > 1e-9]
                    rows.append((NULL, f[j], None, times * float(gamma[j, n:].sum())))
                xi = sum((np.outer(forward[j - 1], emit[:, j] * back[j]) * move / scale[j] for j in range(1, m)), np.zeros((2 * n, 2 * n)))
                moved = xi[:n, :n] + xi[n:, :n]
                for i in range(n):
                    for k in range(n):
                        if moved[i, k] > 1e-9:
                            rows.append((None, None, min(max(k - i, -width), width), times * float(moved[i, k])))
            yield pd.DataFrame(rows, columns=["e", "f", "jump", "c"]).astype({"jump": "Int32", "c": "float64"})

    return _sentences(each, table).mapInPandas(run, "e string, f string, jump int, c double")


def viterbi_hmm(bitext: DataFrame, table: DataFrame, jumps: list[float], width: int = 8, p_null: float = 0.2) -> DataFrame:
    """(pair, src, tgt) on the best path; 0 for NULL."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for pair, e, f, entries in zip(batch.pair, batch.e, batch.f, batch.entries):
                e, f = list(e), list(f)
                if not e or not f:
                    continue
                emit, move, start = lattice(e, f, {(x["e"], x["f"]): x["t"] for x in entries}, jumps, width, p_null)
                with np.errstate(divide="ignore"):
                    emit, move, best = np.log(emit), np.log(move), np.log(start)
                best, trail = best + emit[:, 0], []
                for j in range(1, len(f)):
                    options = best[:, None] + move
                    trail.append(options.argmax(0))
                    best = options.max(0) + emit[:, j]
                path = [int(best.argmax())]
                for back in reversed(trail):
                    path.append(int(back[path[-1]]))
                rows += [(pair, s + 1 if s < len(e) else 0, j + 1) for j, s in enumerate(reversed(path))]
            yield pd.DataFrame(rows, columns=["first", "src", "tgt"])

    kind = bitext.schema["pair"].dataType.simpleString()
    lists = cut(token_lists(bitext))
    each = cut(alike(lists))
    found = _sentences(each, table).mapInPandas(run, f"first {kind}, src int, tgt int")
    named = lists.join(wide(each.select("e", "f", F.col("pair").alias("first"))), ["e", "f"]).select("pair", "first")
    return named.join(wide(found), "first").select("pair", "src", "tgt")


def diagonal(bitext: DataFrame, iterations: int = 5, tension: float = 4.0, p_null: float = 0.08) -> DataFrame:
    """(pair, src, tgt) by a Model 2 whose positions favour the diagonal (Dyer et al. 2013), at a fixed tension."""
    e = bitext.filter("side = 'e'").select("pair", F.col("idx").alias("i"), F.col("tok").alias("e"))
    f = bitext.filter("side = 'f'").select("pair", F.col("idx").alias("j"), F.col("tok").alias("f"))
    size = bitext.groupBy("pair").agg(F.count_if(F.col("side") == "e").alias("n"), F.count_if(F.col("side") == "f").alias("m"))
    cells = e.join(wide(f), "pair").join(wide(size), "pair").withColumn("w", F.exp(-tension * F.abs(F.col("i") / F.col("n") - F.col("j") / F.col("m"))))
    z = cells.groupBy("pair", "j").agg(F.sum("w").alias("zw"))
    cells = cells.join(wide(z), ["pair", "j"]).withColumn("w", (1 - p_null) * F.col("w") / F.col("zw")).select("pair", "i", "e", "j", "f", "w")
    cells = cut(cells.union(f.select("pair", F.lit(0).alias("i"), F.lit(NULL).alias("e"), "j", "f", F.lit(p_null).alias("w"))))
    table = cells.select("e", "f").distinct().withColumn("t", F.lit(1.0))
    for _ in range(iterations):
        seen = cells.join(table, ["e", "f"])
        norm = seen.groupBy("pair", "j").agg(F.sum(F.col("w") * F.col("t")).alias("z"))
        share = seen.join(wide(norm), ["pair", "j"]).groupBy("e", "f").agg(F.sum(F.col("w") * F.col("t") / F.col("z")).alias("c"))
        table = cut(share.join(share.groupBy("e").agg(F.sum("c").alias("s")), "e").select("e", "f", (F.col("c") / F.col("s")).alias("t")))
    best = cells.join(table, ["e", "f"]).groupBy("pair", "j").agg(F.max_by("i", F.struct(F.col("w") * F.col("t"), -F.col("i"))).alias("src"))
    return best.select("pair", "src", F.col("j").alias("tgt")).filter("src > 0")


