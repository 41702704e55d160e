"""Grids of settings over one prepared input, and a store of their results that runs add to.

What all settings share (tokens, contexts, the parts for training and testing) is cut once before the grid; a setting that the store
already holds under the run's name is not run again, so a broken run goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glosspark.operators import align, features
from glosspark.session import cut

RESULTS = "run string, setting string, size bigint, matches bigint, compares bigint, precision double, recall double, f double"
COLUMNS = [c.split()[0] for c in RESULTS.split(", ")]

HEURISTICS = {
    "exact": {"stem": False, "gram": False}, "stem": {"gram": False}, "gram": {"stem": False}, "all": {}, "exact_multi": {"stem": False, "gram": False, "multi": True},
    "all_multi": {"multi": True}, "all_pos": {"pos": True},
}
NO_FEATURES = {"suffix": False, "prefix": False, "prev_gram": False, "next_gram": False, "basic": False, "dict": False}
ABLATION = {
    **{name: {**NO_FEATURES, name: True} for name in NO_FEATURES if name != "dict"}, "suffix_prefix": {**NO_FEATURES, "suffix": True, "prefix": True},
    "context": {**NO_FEATURES, "prev_gram": True, "next_gram": True}, "basic_context": {**NO_FEATURES, "basic": True, "prev_gram": True, "next_gram": True}, "no_context": {"prev_gram": False, "next_gram": False}, "all": {},
}


@dataclass
class Store:
    """Results as Parquet in a folder; every setting is one file added to it."""

    spark: SparkSession
    path: str

    def results(self) -> DataFrame:
        try:
            return self.spark.read.schema(RESULTS).parquet(self.path)
        except AnalysisException:  # nothing has been stored yet
            return self.spark.createDataFrame([], RESULTS)

    def add(self, rows: DataFrame) -> None:
        rows.select(*(F.col(c).cast(k) for c, k in (x.split() for x in RESULTS.split(", ")))).coalesce(1).write.mode("append").parquet(self.path)

    def seen(self, run: str, setting: str) -> bool:
        return not self.results().filter((F.col("run") == run) & (F.col("setting") == setting)).isEmpty()

    def runs(self) -> DataFrame:
        return self.results().select("run").distinct()

    def last_size(self, run: str) -> int | None:
        """The largest input that a run has results for."""
        return self.results().filter(F.col("run") == run).agg(F.max("size")).first()[0]


def grid(store: Store, run: str, settings: dict[str, dict], work: Callable[[dict], DataFrame], size: int) -> DataFrame:
    """The results of all settings of a run; ``work`` gives one row (matches, compares, precision, recall, f) for a setting."""
    for name, setting in settings.items():
        if not store.seen(run, name):
            store.add(work(setting).select(F.lit(run).alias("run"), F.lit(name).alias("setting"), F.lit(size).alias("size"), *COLUMNS[3:]))
    return store.results().filter((F.col("run") == run) & F.col("setting").isin(*settings))


def heuristic_grid(store: Store, run: str, src: DataFrame, tgt: DataFrame, gold: DataFrame, keys: list[str], settings: dict[str, dict] | None = None) -> DataFrame:
    """Heuristic alignment of the same tokens under each setting against gold pairs; ``pos`` needs a ``label`` on both sides."""
    src, tgt, gold = cut(src), cut(tgt), cut(align.pairs(gold, keys))
    known = {"label"} <= {*src.columns} & {*tgt.columns}
    chosen = {k: v for k, v in (settings or HEURISTICS).items() if known or not v.get("pos")}

    def work(setting: dict) -> DataFrame:
        found = align.pairs(align.heuristic(src, tgt, keys, **setting), keys)
        both = found.withColumn("t", F.lit(1)).join(gold.withColumn("g", F.lit(1)), [*keys, "src", "tgt"], "full")
        n = both.agg(F.count_if(F.col("t").isNotNull() & F.col("g").isNotNull()).alias("matches"), F.count("t").alias("compares"), F.count("g").alias("gold"))
        return _scored(n)

    return grid(store, run, chosen, work, src.count())


def _scored(n: DataFrame) -> DataFrame:
    n = n.withColumn("precision", F.try_divide("matches", "compares")).withColumn("recall", F.try_divide("matches", "gold"))
    return n.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def feature_grid(store: Store, run: str, taught: DataFrame, tested: DataFrame, keys: list[str], posdict: DataFrame | None = None, settings: dict[str, dict] | None = None) -> DataFrame:
    """A classifier of gloss words for each choice of features, on ``(key.., idx, tok, label)``, judged on ``tested``."""
    taught, tested = (cut(features.context(x.select(*keys, "idx", "tok", "label"), keys)) for x in (taught, tested))

    def work(setting: dict) -> DataFrame:
        model = features.train(features.gram_features(taught, keys, posdict, **setting))
        asked = features.gram_features(tested.drop("label"), keys, posdict, **setting)
        got = features.classify(model, asked).select(*keys, "idx", F.col("label").alias("guess"))
        n = tested.join(got, [*keys, "idx"], "left").agg(F.count_if(F.col("label") == F.col("guess")).alias("matches"), F.count("guess").alias("compares"), F.count("*").alias("gold"))
        return _scored(n)

    return grid(store, run, settings or ABLATION, work, taught.count())


def projected_or_classified(projected: DataFrame, classified: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(method, matches, compares, precision, recall, f): tags by projection and by classifier against gold tags ``(key.., idx, label)``."""
    rows = projected.select(*keys, "idx", "label").withColumn("method", F.lit("projection")).unionByName(classified.select(*keys, "idx", "label").withColumn("method", F.lit("classifier")))
    total = gold.agg(F.count("*").alias("gold"))  # one row
    n = rows.join(gold.select(*keys, "idx", F.col("label").alias("true")), [*keys, "idx"]).groupBy("method").agg(F.count_if(F.col("label") == F.col("true")).alias("matches"), F.count("*").alias("compares"))
    return _scored(n.crossJoin(F.broadcast(total))).drop("gold")
