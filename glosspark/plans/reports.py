"""Corpus reports and training-data extraction, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.operators import align, counts, evaluate, features, lines, project

KEYS = ["igt_id"]


def corpus_statistics(raw: DataFrame, tokens: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row: instances, corrupt and two-column ones, and lower-cased tokens and types of language, gloss and translation words."""
    flags = raw.groupBy("igt_id").agg(F.max(lines.has_label(F.col("tag"), "CR").cast("int")).alias("cr"), F.max(lines.has_label(F.col("tag"), "DB").cast("int")).alias("db"))
    out = flags.agg(F.count("*").alias("instances"), F.sum("cr").alias("corrupt"), F.sum("db").alias("two_column"))
    by_word = tokens.groupBy("tier", F.lower("tok").alias("tok")).agg(F.count("*").alias("n"))
    for tier, name in (("w", "lang"), ("gw", "gloss"), ("tw", "trans")):
        own = F.col("tier") == tier
        out = out.join(by_word.agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"{name}_tokens"), F.count_if(own).alias(f"{name}_types")))  # one row each
    if tags is not None:
        out = out.join(tags.agg(F.count("*").alias("tags")))
    return out


def gloss_tag_counts(grams: DataFrame, words: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, tag, n) and (gram, tag, n) from tagged gloss words and their parts."""
    t = tags.select(*KEYS, "idx", "label")
    w = words.join(t, [*KEYS, "idx"]).select(F.lower("tok").alias("word"), F.col("label").alias("tag"))
    g = grams.join(t.withColumnRenamed("idx", "word_idx"), [*KEYS, "word_idx"]).select(F.lower("tok").alias("word"), F.col("label").alias("tag"))
    return counts.count(w, "word", "tag"), counts.count(g, "word", "tag")


def classifier_lines(grams: DataFrame, tags: DataFrame, posdict: DataFrame | None = None, threshold: int = 1) -> DataFrame:
    """Training lines of every tagged gram whose form occurs ``threshold`` times or more."""
    rows = features.context(grams.select(*KEYS, "idx", "word_idx", "tok"), KEYS)
    rows = rows.join(tags.select(*KEYS, F.col("idx").alias("word_idx"), "label"), [*KEYS, "word_idx"])
    often = rows.groupBy(F.lower("tok").alias("_f")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= threshold)
    kept = rows.join(often, F.lower("tok") == F.col("_f"), "left_semi")
    return features.training_lines(features.gram_features(kept, KEYS, posdict))


PUNCTUATION_LINES = [f"{p}/PUNC" for p in (".", ",", "!", "?", ";", ":")]


def tagger_lines(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """``word/TAG`` sentences without ``*`` and ``#``, and one line for each punctuation mark."""
    rows = tokens.join(tags.select(*KEYS, "idx", "label"), [*KEYS, "idx"]).withColumn("form", F.translate("tok", "*#", ""))
    own = rows.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "form", "label"))), lambda t: F.concat_ws("/", t["form"], t["label"])), " ").alias("value")).select("value")
    return own.unionByName(tokens.sparkSession.createDataFrame([(x,) for x in PUNCTUATION_LINES], "value string"))


def tagger_corpus(layers: dict[str, DataFrame], method: str = "projected", unknown: str | None = None) -> DataFrame:
    """Tagged language words of enriched instances by projection through the gloss, or straight from the translation."""
    tier = layers["token"].filter("tier = 'w'")
    if method == "direct":
        tags = project.across(layers["trans_lang"], layers["trans_tag"], KEYS, unknown)
    else:
        tags = project.across(layers["gloss_lang"], layers["gloss_tag"], KEYS, unknown)
    return tagger_lines(tier, tags)


ABLATION = [
    {"name": "exact", "stem": False, "gram": False}, {"name": "stem", "stem": True, "gram": False}, {"name": "gram", "stem": False, "gram": True},
    {"name": "all", "stem": True, "gram": True}, {"name": "all_multi", "stem": True, "gram": True, "multi": True},
]


def alignment_grid(src: DataFrame, tgt: DataFrame, gold: DataFrame, keys: list[str], settings: list[dict] | None = None) -> DataFrame:
    """AER, precision, recall of heuristic settings against gold pairs, and pooled."""
    test = None
    for s in settings or ABLATION:
        own = align.heuristic(src, tgt, keys, **{k: v for k, v in s.items() if k != "name"}).withColumn("method", F.lit(s["name"]))
        test = own if test is None else test.unionByName(own)
    n = evaluate.alignment_counts(gold, test, keys, ["method"]).join(gold.agg(F.count("*").alias("gold")))  # one row
    return evaluate.alignment_scores(n)


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
