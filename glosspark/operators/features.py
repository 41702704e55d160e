"""Features of gloss units for tagging, their training text, and a multinomial classifier over them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions import text as T

NONE = "**NONE**"
DEFAULTS = {"suffix": True, "prefix": True, "prev_gram": True, "next_gram": True, "basic": True, "dict": True, "has_number": False, "align": False, "morph_num": False}


def context(tokens: DataFrame, keys: list[str], column: str = "tok") -> DataFrame:
    """``prev`` and ``next`` token of each token of an instance; ``**NONE**`` at its edges."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY idx)"
    return tokens.withColumn("prev", F.expr(f"lag({column}, 1, '{NONE}') {over}")).withColumn("next", F.expr(f"lead({column}, 1, '{NONE}') {over}"))


def dictionary(counts: DataFrame) -> DataFrame:
    """(word, tags): the two most frequent tags of each word of ``counts(word, tag, n)``."""
    ranked = counts.withColumn("rn", F.expr("row_number() OVER (PARTITION BY word ORDER BY n DESC, tag)")).filter("rn <= 2")
    return ranked.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]).alias("tags"))


def gram_features(tokens: DataFrame, keys: list[str], posdict: DataFrame | None = None, **switches: bool) -> DataFrame:
    """``tokens(key.., idx, tok, prev, next[, aligned])`` with ``features``, an array of names.

    The dictionary is joined once, on the exploded morphs of the unit and of its neighbours.
    """
    on = DEFAULTS | switches
    form = T.gram_form("tok")
    rows = tokens.withColumn("_form", form).withColumn("_m", T.morphs("_form"))
    near = lambda c: F.when(F.col(c) == NONE, F.array().cast("array<string>")).otherwise(T.morphs(F.lower(F.col(c))))
    rows = rows.withColumn("_p", near("prev")).withColumn("_n", near("next"))
    named = lambda x, head: F.transform(x, lambda v: F.concat(F.lit(head), v))
    parts: list[Column] = []
    if on["has_number"]:
        parts.append(F.when(F.col("_form").rlike("[0-9]"), F.array(F.lit("has-number"))))
    if on["align"]:
        parts.append(named(F.col("aligned"), "aln-label-"))
    if on["suffix"]:
        parts += [F.array(F.concat(F.lit(f"gram-suffix-{k}-"), F.right("_form", F.lit(k)))) for k in (3, 2, 1)]
    if on["prefix"]:
        parts += [F.array(F.concat(F.lit(f"gram-prefix-{k}-"), F.left("_form", F.lit(k)))) for k in (3, 2, 1)]
    if on["morph_num"]:
        parts.append(F.array(F.concat(F.size("_m").cast("string"), F.lit("-morphs"))))
    for switch, column, head in (("prev_gram", "_p", "prev-gram-"), ("next_gram", "_n", "next-gram-")):
        if on[switch]:
            parts.append(F.when(F.size(column) == 0, F.array(F.lit(head + NONE))).otherwise(F.transform(column, lambda v: F.concat(F.lit(head), T.fix_gram(v)))))  # noqa: B023
    if on["basic"]:
        parts.append(F.col("_m"))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("features", F.concat(*(F.coalesce(p, empty) for p in parts)) if parts else empty)
    if posdict is not None and on["dict"]:
        asked = rows.select(*keys, "idx", F.explode(F.concat(named(F.col("_m"), "m"), named(F.col("_p"), "p"), named(F.col("_n"), "n"))).alias("x"))
        asked = asked.select(*keys, "idx", F.left("x", F.lit(1)).alias("side"), F.expr("substring(x, 2)").alias("word")).join(posdict, "word")
        names = F.when(F.col("side") == "m", F.concat(F.array(F.concat(F.lit("top-dict-word-"), F.get("tags", F.lit(0)))), F.when(F.size("tags") > 1, F.array(F.concat(F.lit("next-dict-word-"), F.get("tags", F.lit(1))))).otherwise(empty)))
        names = names.when(F.col("side") == "p", F.array(F.concat(F.lit("prev-gram-dict-tag-"), F.get("tags", F.lit(0))))).otherwise(F.array(F.concat(F.lit("next-gram-dict-tag-"), F.get("tags", F.lit(0)))))
        more = asked.withColumn("f", F.explode(names)).groupBy(*keys, "idx").agg(F.sort_array(F.collect_list("f")).alias("_d"))
        rows = rows.join(more, [*keys, "idx"], "left").withColumn("features", F.concat("features", F.coalesce("_d", empty))).drop("_d")
    return rows.drop("_form", "_m", "_p", "_n")


def training_lines(rows: DataFrame) -> DataFrame:
    """``label<TAB>feature:1<TAB>...`` lines."""
    return rows.select(F.concat_ws("\t", F.col("label"), F.array_join(F.transform("features", lambda f: F.concat(f, F.lit(":1"))), "\t")).alias("value"))


def train(rows: DataFrame, max_features: int = 1 << 18):
    """A maximum-entropy model over ``rows(features, label)``."""
    steps = [CountVectorizer(inputCol="features", outputCol="x", binary=True, vocabSize=max_features), StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, family="multinomial")]
    return Pipeline(stages=steps).fit(rows)


PUNC = r"""^[.?"';/,]"""


def classify(model, rows: DataFrame) -> DataFrame:
    """``rows(tok, features)`` with ``label``: PUNC for punctuation, UNK for an empty token, else the model's best."""
    labels = F.array(*map(F.lit, model.stages[1].labels))
    out = model.stages[2].transform(model.stages[0].transform(rows))
    best = F.get(labels, F.col("prediction").cast("int"))
    return out.withColumn("label", F.when(F.coalesce("tok", F.lit("")) == "", "UNK").when(F.col("tok").rlike(PUNC), "PUNC").otherwise(best)).drop("x", "rawPrediction", "probability", "prediction")


def feature_info(model, top: int = 10) -> list[tuple[str, str, float]]:
    """The heaviest features of each class of a fitted model, which is no larger than classes times vocabulary."""
    weights, words = model.stages[2].coefficientMatrix.toArray(), model.stages[0].vocabulary
    return [(label, words[j], float(weights[i][j])) for i, label in enumerate(model.stages[1].labels) for j in weights[i].argsort()[::-1][:top]]
