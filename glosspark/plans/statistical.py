"""Statistical alignment of two tiers: sentence pairs, a model for each direction, and their combination.

Tokens are ``(key.., idx, tok)``; white space inside a token is dropped and case ignored. Links are ``(key.., src, tgt)`` without NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators import align, em, fertility
from glosspark.session import cut, wide

METHODS = ("ibm1", "hmm", "fertility", "diagonal")


def sentence_pairs(src: DataFrame, tgt: DataFrame, keys: list[str], extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``bitext(pair, side, idx, tok)`` with ``src`` as side e and ``tgt`` as side f, and ``(pair, key..)``.

    Instances that lack a side are left out. Each row of ``extra(src_tok, tgt_tok)`` is one more pair of one word a side, which
    teaches the models but has no instance.
    """
    tok = F.lower(F.regexp_replace("tok", r"\s+", ""))
    own = src.select(*keys).distinct().join(wide(tgt.select(*keys).distinct()), keys)
    names = cut(own.withColumn("pair", F.concat(F.lit("s"), F.to_json(F.struct(*keys)))))
    rows = [side.join(wide(names), keys).select("pair", F.lit(s).alias("side"), F.col("idx").cast("int").alias("idx"), tok.alias("tok")) for s, side in (("e", src), ("f", tgt))]
    bitext = rows[0].unionByName(rows[1])
    if extra is not None:
        n = extra.groupBy(F.lower("src_tok").alias("e"), F.lower("tgt_tok").alias("f")).agg(F.count("*").alias("n"))
        each = n.select("e", "f", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i")).select(F.concat(F.lit("x"), F.to_json(F.struct("e", "f", "i"))).alias("pair"), "e", "f")
        bitext = bitext.unionByName(each.select("pair", F.explode(F.array(F.struct(F.lit("e").alias("side"), F.col("e").alias("tok")), F.struct(F.lit("f").alias("side"), F.col("f").alias("tok")))).alias("x")).select("pair", "x.side", F.lit(1).alias("idx"), "x.tok"))
    return cut(bitext), names


def swapped(bitext: DataFrame) -> DataFrame:
    return bitext.withColumn("side", F.when(F.col("side") == "e", "f").otherwise("e"))


def directed(bitext: DataFrame, method: str = "hmm", iterations: int = 5, stored: str | None = None) -> DataFrame:
    """(pair, src, tgt): each f word's e word under a model trained on ``bitext``, or for ``fertility`` under stored tables, without training."""
    if method == "ibm1":
        out = em.viterbi1(bitext, em.ibm1(bitext, iterations))
    elif method == "hmm":
        out = em.viterbi_hmm(bitext, *em.hmm(bitext, em.ibm1(bitext, iterations), iterations))
    elif method == "fertility":
        model = fertility.Model.load(bitext.sparkSession, stored) if stored else fertility.train(bitext, iterations)[0]
        out = fertility.viterbi(bitext, model)
    elif method == "diagonal":
        out = em.diagonal(bitext, iterations)
    else:
        raise ValueError(f"unknown aligner {method}: one of {', '.join(METHODS)}")
    return out.filter("src > 0").select("pair", "src", "tgt")


def aligned(src: DataFrame, tgt: DataFrame, keys: list[str], method: str = "hmm", symmetrize: str | None = "intersection", extra: DataFrame | None = None, iterations: int = 5, stored: tuple[str, str] | None = None) -> DataFrame:
    """Links of ``src`` with ``tgt``: one direction alone, or both combined by a symmetrizer (``refined`` too).

    ``stored`` names folders of fertility models for either direction.
    """
    bitext, names = sentence_pairs(src, tgt, keys, extra)
    there = cut(directed(bitext, method, iterations, stored and stored[0]))
    if symmetrize is not None:
        combine = {**align.SYMMETRIZERS, "refined": align.refined}
        if symmetrize not in combine:
            raise ValueError(f"unknown symmetrizer {symmetrize}: one of {', '.join(combine)}")
        back = cut(align.flip(directed(swapped(bitext), method, iterations, stored and stored[1]), ["pair"]))
        there = combine[symmetrize](there, back, ["pair"])
    return there.join(wide(names), "pair").select(*keys, "src", "tgt").distinct()


def train_stored(src: DataFrame, tgt: DataFrame, keys: list[str], folders: tuple[str, str], extra: DataFrame | None = None, iterations: int = 5) -> list[list[float]]:
    """Train fertility models of both directions and store their tables; the perplexities of either."""
    bitext, _ = sentence_pairs(src, tgt, keys, extra)
    seen = []
    for side, folder in ((bitext, folders[0]), (swapped(bitext), folders[1])):
        model, perplexity = fertility.train(side, iterations)
        model.save(folder)
        seen.append(perplexity)
    return seen


def parallel_lines(spark: SparkSession, src: str, tgt: str) -> tuple[DataFrame, DataFrame]:
    """Tokens ``(line, idx, tok)`` of two files whose lines correspond."""

    def tokens(path: str) -> DataFrame:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
        return lines.select("line", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "tok")).select("line", (F.col("i") + 1).alias("idx"), "tok")

    return tokens(src), tokens(tgt)


def preferred(layers: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Of ``layers(key.., method, ..)`` each instance's rows of the first method of ``order`` that it has; other methods count for nothing."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    ranked = layers.withColumn("_rank", rank).filter("_rank > 0")
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(wide(best), [*keys, "_rank"], "left_semi").drop("_rank")
