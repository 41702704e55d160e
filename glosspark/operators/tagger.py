"""Tagging words of a line: features of form, ending and neighbours for a conditional random field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.operators import crf
from glosspark.operators.features import context


def word_features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens(key.., idx, tok)`` with ``features``: form, endings and beginnings of up to three letters, shape, both neighbours."""
    rows = context(tokens.withColumn("_low", F.lower("tok")), keys, "_low")
    named = lambda head, x: F.concat(F.lit(head), x)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("tok", r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\p{N}+", "0")
    ends = [named(f"s{k}=", F.right("_low", F.lit(k))) for k in (1, 2, 3)] + [named(f"p{k}=", F.left("_low", F.lit(k))) for k in (1, 2, 3)]
    own = F.array(named("w=", F.col("_low")), named("shape=", shape), named("before=", F.col("prev")), named("behind=", F.col("next")), named("both=", F.concat_ws("|", "prev", "next")), *ends)
    return rows.withColumn("features", own).drop("_low", "prev", "next")


def train(tokens: DataFrame, keys: list[str], iterations: int = 25, least: int = 1) -> crf.Model:
    """A tagger from ``tokens(key.., idx, tok, label)``; it is a table of weights that ``Model.save`` stores."""
    return crf.train(word_features(tokens, keys), keys, iterations, least=least)[0]


def tag(tokens: DataFrame, keys: list[str], model: crf.Model, best: int = 1) -> DataFrame:
    """``(key.., rank, idx, label, score)``; tokens may carry ``allowed`` tags."""
    return crf.tag(word_features(tokens, keys), keys, model, best)
