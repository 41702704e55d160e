"""Evaluation: confusion matrices and what follows from them, tag mappings, alignment error rate, liberal matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred) rows to (gold, pred, n)."""
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Matches, total, accuracy in percent; ``mapping(pred, mapped)`` renames predictions first."""
    m = matrix
    if mapping is not None:
        m = m.join(mapping, "pred", "left").withColumn("pred", F.coalesce("mapped", "pred"))
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return m.agg(hit.alias("matches"), F.sum("n").alias("total"), (100 * F.try_divide(hit, F.sum("n"))).alias("accuracy"))


def by_tag(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F of every tag in percent, 0 where a denominator is."""
    gold = matrix.groupBy(F.col("gold").alias("tag")).agg(F.sum("n").alias("gold"))
    pred = matrix.groupBy(F.col("pred").alias("tag")).agg(F.sum("n").alias("pred"))
    hit = matrix.filter("gold = pred").select(F.col("gold").alias("tag"), F.col("n").alias("hit"))
    out = gold.join(pred, "tag", "full").join(hit, "tag", "left").fillna(0, ["gold", "pred", "hit"])
    out = out.withColumn("precision", F.coalesce(100 * F.try_divide("hit", "pred"), F.lit(0.0))).withColumn("recall", F.coalesce(100 * F.try_divide("hit", "gold"), F.lit(0.0)))
    return out.withColumn("fmeasure", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def many_to_one(matrix: DataFrame) -> DataFrame:
    """Each predicted tag mapped to the gold tag it meets most; equal counts go to the first in order."""
    best = matrix.filter("n > 0").withColumn("rn", F.expr("row_number() OVER (PARTITION BY pred ORDER BY n DESC, gold)"))
    return best.filter("rn = 1").select("pred", F.col("gold").alias("mapped"))


def one_to_one(matrix: DataFrame) -> dict[str, str]:
    """A one-to-one mapping pred -> gold by swaps that gain matches until none does.

    Works on the collected matrix, which is no larger than the tag set squared.
    """
    cell = {(r.gold, r.pred): r.n for r in matrix.collect()}
    tags = sorted({t for pair in cell for t in pair})
    mapping = {t: t for t in tags}
    gain = lambda a, b: cell.get((mapping[b], a), 0) + cell.get((mapping[a], b), 0) - cell.get((mapping[a], a), 0) - cell.get((mapping[b], b), 0)
    while True:
        swaps = [(gain(a, b), a, b) for i, a in enumerate(tags) for b in tags[i + 1 :]]
        best = max(swaps, default=(0, "", ""), key=lambda s: (s[0], [-ord(c) for c in s[1] + s[2]]))
        if best[0] <= 0:
            return mapping
        _, a, b = best
        mapping[a], mapping[b] = mapping[b], mapping[a]


def error_matrix(matrix: DataFrame, tags: list[str]) -> DataFrame:
    """Gold rows by predicted columns, with totals."""
    return matrix.groupBy("gold").pivot("pred", tags).agg(F.sum("n")).fillna(0).withColumn("total", sum((F.col(f"`{t}`") for t in tags), F.lit(0)))


def alignment_counts(gold: DataFrame, test: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Matches, test and gold pairs by the columns ``by`` of ``test`` (a method, a language)."""
    g = gold.select(*keys, "src", "tgt").distinct().withColumn("hit", F.lit(1))
    t = test.select(*by, *keys, "src", "tgt").distinct().join(g, [*keys, "src", "tgt"], "left")
    n = t.groupBy(*by).agg(F.count("*").alias("test"), F.count("hit").alias("matches"))
    return n


def alignment_scores(counts: DataFrame) -> DataFrame:
    """AER, precision, recall, F from pooled matches, test, gold; 0 where a denominator is."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = counts.withColumn("precision", zero(F.try_divide("matches", "test"))).withColumn("recall", zero(F.try_divide("matches", "gold")))
    out = out.withColumn("fmeasure", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return out.withColumn("aer", 1 - zero(F.try_divide(2 * F.col("matches"), F.col("test") + F.col("gold"))))


def liberal(gold: DataFrame, projected: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens counted right if the gold label is among their projected labels; tokens without either do not count."""
    p = projected.filter("label IS NOT NULL").groupBy(*keys, "idx").agg(F.collect_set("label").alias("labels"))
    j = gold.filter("label IS NOT NULL").join(p, [*keys, "idx"])
    return j.agg(F.sum(F.array_contains("labels", F.col("label")).cast("int")).alias("matches"), F.count("*").alias("compared"))
