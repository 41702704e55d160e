"""Counters: two-level counts, marginals, top-n, corpus and tag statistics, constraints, prototypes, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.operators.corpus import running


def count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def combine(*counts: DataFrame) -> DataFrame:
    """Partial counts added up."""
    keys = [c for c in counts[0].columns if c != "n"]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame, add: float = 0.0) -> DataFrame:
    """Add-n distribution over all keys."""
    total = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) + add * F.count("*")).alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("p", (F.col("n") + F.lit(float(add))) / F.col("_t")).drop("_t")


def marginals(counts: DataFrame, k1: str, k2: str) -> DataFrame:
    """Counts with the inner share of each outer key and the outer key's share of all, from one rollup-free pass per level."""
    outer = counts.groupBy(k1).agg(F.sum("n").alias("total"))
    all_ = counts.agg(F.sum("n").alias("grand"))
    out = counts.join(outer, k1).crossJoin(F.broadcast(all_))  # one row
    return out.select(k1, k2, "n", "total", (F.col("n") / F.col("total")).alias("inner_share"), (F.col("total") / F.col("grand")).alias("outer_share"))


def top_n(counts: DataFrame, k1: str, k2: str, n: int, keep: str | None = None) -> DataFrame:
    """The n largest inner keys of each outer key; equal counts in key order; ``keep`` filters inner keys by pattern."""
    rows = counts if keep is None else counts.filter(F.col(k2).rlike(keep))
    return rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {k1} ORDER BY n DESC, {k2})")).filter(F.col("rank") <= n)


def most_frequent(counts: DataFrame, k1: str, k2: str, least: int = 0, drop: str | None = None) -> DataFrame:
    """Each outer key's largest inner key that counts over ``least``; ``drop`` excludes inner keys by pattern."""
    rows = counts.filter(F.col("n") > least)
    rows = rows if drop is None else rows.filter(~F.col(k2).rlike(drop))
    best = rows.groupBy(k1).agg(F.max_by(F.struct(k2, "n"), F.struct(F.col("n"), F.lit(0))).alias("_"), F.max("n").alias("n"))
    return rows.join(best.select(k1, "n"), [k1, "n"]).groupBy(k1).agg(F.min(k2).alias(k2), F.max("n").alias("n"))


def tag_statistics(tokens: DataFrame, order: list[str]) -> DataFrame:
    """Per label: tokens, types by the label each form is first seen with, and both shares; ``order`` ranks the tokens."""
    first = tokens.groupBy("form").agg(F.min_by("label", F.struct(*order)).alias("label")).groupBy("label").agg(F.count("*").alias("types"))
    out = tokens.groupBy("label").agg(F.count("*").alias("tokens")).join(first, "label", "left").fillna(0, ["types"])
    return out.withColumn("token_share", F.expr("100D * tokens / sum(tokens) OVER ()")).withColumn("type_share", F.expr("100D * types / sum(types) OVER ()"))


def constraints(counts: DataFrame, word: str, tag: str, least: int = 3) -> DataFrame:
    """Words seen ``least`` times or more: their two top tags with renormalised probabilities."""
    seen = counts.groupBy(word).agg(F.sum("n").alias("t")).filter(F.col("t") >= least).select(word)
    top = top_n(counts.join(seen, word, "left_semi"), word, tag, 2)
    return top.select(word, tag, F.expr(f"n / sum(n) OVER (PARTITION BY {word})").alias("p"))


def prototypes(counts: DataFrame, word: str, tag: str, most: int) -> DataFrame:
    """Per tag the most frequent words (over 1) whose own most frequent tag it is."""
    best = top_n(counts, word, tag, 1).filter("n > 1").drop("rank")
    return top_n(best, tag, word, most)


def repeated_rows(counts: DataFrame, key: str, threshold: int = 1) -> DataFrame:
    """One row per occurrence, for keys whose total reaches the threshold."""
    kept = counts.withColumn("t", F.expr(f"sum(n) OVER (PARTITION BY {key})")).filter(F.col("t") >= threshold)
    return kept.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("t", "i", "n")


def vocabulary(tokens: DataFrame, order: list[str], first_id: int = 2) -> DataFrame:
    """word, id by first occurrence from ``first_id``, count; ranked by ranges, so that no task sorts all words."""
    words = tokens.groupBy("tok").agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("_c"))
    ranked = running(words.withColumn("n", F.lit(1)), ["at"])
    return ranked.select("tok", (F.col("upto") + (first_id - 1)).cast("int").alias("id"), F.col("_c").alias("n"))


def cooccurrence(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (src_id, tgt_id) of words that share an instance, with source 0 for NULL."""
    s = src.select(*keys, F.col("id").alias("src_id")).distinct()
    t = tgt.select(*keys, F.col("id").alias("tgt_id")).distinct()
    return s.join(t, keys).select("src_id", "tgt_id").union(t.select(F.lit(0).alias("src_id"), "tgt_id")).distinct()


def pattern_tokens(x: Column) -> Column:
    """Lower-cased tokens of a text column."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[^ \t\n\r\f\x0B]+"), 0)
