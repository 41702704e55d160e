"""Carrying tags across alignments. Tags are ``(key..., idx, label)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.session import wide

# fixed values: which of several projected tags wins
PRECEDENCE = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "CONJ", "PRT", "NUM", "PUNC", "X"]


def precedence(label: Column, order: list[str] | None = None) -> Column:
    at = F.array_position(F.array(*map(F.lit, order or PRECEDENCE)), label)
    return F.when(at > 0, at)


def by_precedence(aln: DataFrame, tags: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Each target's tag from its sources: the first one's if it is outside the list, else the highest in the list."""
    t = aln.join(wide(tags.withColumnRenamed("idx", "src")), [*keys, "src"]).withColumn("rank", precedence(F.col("label"), order))
    t = t.groupBy(*keys, "tgt").agg(F.min_by(F.struct("label", "rank"), F.struct("src", "tgt")).alias("first"), F.min_by("label", F.when(F.col("rank").isNotNull(), F.struct("rank", "src"))).alias("best"))
    return t.select(*keys, F.col("tgt").alias("idx"), F.when(F.col("first.rank").isNull(), F.col("first.label")).otherwise(F.coalesce("best", "first.label")).alias("label"))


def across(aln: DataFrame, tags: DataFrame, keys: list[str], unknown: str | None = None) -> DataFrame:
    """Tags of sources given to their targets; an untagged source is skipped, or gives ``unknown``."""
    t = aln.join(wide(tags.withColumnRenamed("idx", "src")), [*keys, "src"], "inner" if unknown is None else "left")
    label = F.col("label") if unknown is None else F.coalesce("label", F.lit(unknown))
    return t.select(*keys, F.col("tgt").alias("idx"), label.alias("label")).distinct()


def mapped(tags: DataFrame, tagmap: DataFrame, keep: bool = True) -> DataFrame:
    """Labels through ``tagmap(fine, coarse)``; an unknown label stays, or its row goes."""
    t = tags.join(tagmap, tags.label == tagmap.fine, "left" if keep else "inner")
    return t.select(*(tags[c] for c in tags.columns if c != "label"), F.coalesce("coarse", "label").alias("label"))


def upsert(tags: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``tags`` with the layers (key, tier, method) of ``new`` put in place of what they had."""
    layer = [*keys, "tier", "method"]
    return tags.join(wide(new.select(*layer).distinct()), layer, "left_anti").unionByName(new)


def sequence(tokens: DataFrame, tags: DataFrame, keys: list[str], unknown: str = "UNK") -> DataFrame:
    """Every token with its tag, or ``unknown``."""
    return tokens.join(wide(tags.select(*keys, "idx", "label")), [*keys, "idx"], "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def override_gloss(gloss: Column, label: Column) -> Column:
    """Fixed readings of some gloss words that outweigh a predicted tag."""
    return (
        F.when(gloss.isin("foc", "top", "seq", "add", "emph", "cit", "rep"), "PRT")
        .when(gloss.isin("but", "and", "or"), "CONJ")
        .when(F.contains(gloss, F.lit("dem")), "PRON")
        .when(gloss.isin("for", "in"), "ADP")
        .when(gloss == "the", "DET")
        .otherwise(label)
    )
