"""Corpus-level operators: requirements, splits, prefixes, leave-one-out, tier order, provenance, concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.session import cut

# fixed values of the format: the order of tiers in an instance
TIER_ORDER = ["o", "c", "n", "p", "w", "m", "g", "w-pos", "t", "tw", "tw-pos", "ps", "a", "dt", "dtb"]


GROUPS = 1000  # that leave_one_out names


def require_lines(instances: DataFrame, lines: DataFrame, tags: list[str], key: str = "igt_id") -> DataFrame:
    """Instances that have a line of every tag."""
    for tag in tags:
        instances = instances.join(lines.filter(F.array_contains(F.split("tag", r"\+"), tag)).select(key), key, "left_semi")
    return instances


def require_one_to_one(instances: DataFrame, tokens: DataFrame, a: str, b: str, key: str = "igt_id") -> DataFrame:
    """Instances with as many tokens in tier ``a`` as in tier ``b``."""
    n = tokens.groupBy(key).agg(F.count_if(F.col("tier") == a).alias("na"), F.count_if(F.col("tier") == b).alias("nb")).filter("na = nb")
    return instances.join(n, key, "left_semi")


def require_tags(instances: DataFrame, tags: DataFrame, tier: str, key: str = "igt_id") -> DataFrame:
    return instances.join(tags.filter(F.col("tier") == tier), key, "left_semi")


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; null counts as no."""
    return rows.filter(F.coalesce(condition, F.lit(False)))


def without_methods(layers: DataFrame, methods: list[str]) -> DataFrame:
    return layers.filter(~F.coalesce(F.col("method"), F.lit("")).isin(*methods))


def running(sizes: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """``sizes(.., n)`` with ``upto``, the running sum in ``order``, without sorting all rows in one task.

    Ranges of ``order`` are dealt out by sampling; each range sums its own rows, and the sums of the ranges before (one row
    per range) are added. A null size counts as 0. Rows travel as one struct, so no other column's name can clash; a column ``upto``
    is replaced.
    """
    return _running(sizes, F.col("n"), order, buckets).select(*(F.col(f"row.`{c}`").alias(c) for c in sizes.columns if c != "upto"), F.col("total").alias("upto"))


def _running(rows: DataFrame, size: Column, order: list[str], buckets: int = 64) -> DataFrame:
    """``(row, total)``: all columns of ``rows`` in a struct, and the running sum of ``size``."""
    places = [f"o{i}" for i in range(len(order))]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.coalesce(size, F.lit(0)).alias("size"), *(F.col(c).alias(p) for c, p in zip(order, places)))
    ranged = cut(packed.repartitionByRange(buckets, *places).withColumn("p", F.spark_partition_id()))  # read twice, and each sampling has its own ranges
    own = F.expr(f"sum(size) OVER (PARTITION BY p ORDER BY {', '.join(places)} ROWS UNBOUNDED PRECEDING)")
    totals = ranged.groupBy("p").agg(F.sum("size").alias("t")).withColumn("before", F.expr("coalesce(sum(t) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return ranged.withColumn("own", own).join(F.broadcast(totals.select("p", "before")), "p").select("row", (F.col("own") + F.col("before")).alias("total"))  # at most ``buckets`` rows


def split(sizes: DataFrame, order: list[str], train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """``sizes(.., n)`` with ``part``: instances up to the first whose running tokens reach round(train * N) (half to even) train, and so on.

    The instance at a boundary belongs to the later part.
    """
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    rows = _running(sizes, F.col("n"), order).crossJoin(F.broadcast(whole))  # one row
    edge = lambda p: F.bround(F.lit(p) * F.col("whole")).cast("bigint")
    part = F.when(F.col("total") < edge(train), "train").when(F.col("total") < edge(train + dev), "dev").otherwise("test")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in sizes.columns if c not in ("upto", "part")), F.col("total").alias("upto"), part.alias("part"))


def whole_curve(rows: DataFrame, order: list[str], step: int, value: str) -> DataFrame:
    """(size, sentences, total): rows and the sum of ``value`` over each prefix of step, 2 * step, ... rows; the last size holds all.

    Every step is summed once, and running totals go over the steps.
    """
    size = (F.ceil(F.col("upto") / step) * step).cast("int").alias("size")
    ranked = running(rows.select(*order, F.col(value).alias("_v"), F.lit(1).alias("n")), order)
    steps = cut(ranked.groupBy(size).agg(F.sum("n").alias("_n"), F.sum("_v").alias("n")))
    totals = running(steps, ["size"]).select("size", F.col("_n").alias("n"), F.col("upto").alias("total"))
    return running(totals, ["size"]).select("size", F.col("upto").alias("sentences"), "total")


def first_share(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """The first round(share * n) rows."""
    counted = _running(rows, F.lit(1), order).crossJoin(F.broadcast(rows.agg(F.count("*").alias("whole"))))  # one row
    return counted.filter(F.col("total") <= F.bround(F.lit(share) * F.col("whole"))).select("row.*")


def leave_one_out(counts: DataFrame, group: str) -> DataFrame:
    """For each group the counts of all others, as total minus own.

    The result names every group beside every key, so groups have to be few: over ``GROUPS`` of them raise. Their names are a
    constant of the plan, and totals are exploded over it.
    """
    keys = [c for c in counts.columns if c not in (group, "n")]
    names = [r[0] for r in counts.select(group).distinct().limit(GROUPS + 1).collect()]
    if len(names) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups to leave out")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total")).withColumn("_g", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    own = counts.select(F.col(group).alias("_o"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n")
    same = F.col("_g").eqNullSafe(F.col("_o"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return total.join(own, same, "left").select(F.col("_g").cast(counts.schema[group].dataType).alias(group), *keys, (F.col("total") - F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")


def random_rows(rows: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, those of the smallest hashes of seed and key: the same on every run."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    return rows.withColumn("_mark", mark).orderBy("_mark", *key).limit(n).drop("_mark")


def distinct_in_order(values: Column) -> Column:
    """An array without later repeats."""
    return F.array_distinct(values)


def positions(values: Column, wanted: Column) -> Column:
    """All places, from 0, at which ``wanted`` stands in the array."""
    return F.filter(F.transform(values, lambda v, i: F.when(v == wanted, i)), lambda i: i.isNotNull())


def word_level(tiers: DataFrame) -> DataFrame:
    """``tiers(.., tier_type, token_type, aligned_type)`` with ``word_level``: glosses marked as of words, or aligned to a words tier."""
    marked = (F.col("token_type") == "word") | (F.col("aligned_type") == "words")
    return tiers.withColumn("word_level", (F.col("tier_type") == "glosses") & F.coalesce(marked, F.lit(False)))


def concatenate(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def chunks(rows: DataFrame, order: list[str], number: int) -> DataFrame:
    """Contiguous chunks of nearly equal size, numbered from 0; a column ``chunk`` is replaced."""
    counted = _running(rows, F.lit(1), order).crossJoin(F.broadcast(rows.agg(F.count("*").alias("whole"))))  # one row
    chunk = F.least(F.floor((F.col("total") - 1) * number / F.col("whole")), F.lit(number - 1)).cast("int")
    return counted.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != "chunk"), chunk.alias("chunk"))


def tier_rank(tier_id: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TIER_ORDER)), tier_id)
    return F.when(at > 0, at).otherwise(len(TIER_ORDER) + 1)


def fresh_tier_id(base: Column, taken: Column) -> Column:
    """``base``, or ``base_b``, ``base_c``, ... for the first letter that the array ``taken`` leaves free."""
    options = F.concat(F.array(base), F.transform(F.sequence(F.lit(ord("b")), F.lit(ord("z"))), lambda c: F.concat(base, F.lit("_"), F.chr(c))))
    return F.get(F.filter(options, lambda o: ~F.array_contains(taken, o)), F.lit(0))


def item_ids(rows: DataFrame, base: Column, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("item_id", F.concat(base, F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})").cast("string")))


def find_meta(metas: Column, kind: str) -> Column:
    """The first meta of a type, or null."""
    return F.get(F.filter(metas, lambda m: m["type"] == kind), F.lit(0))


def set_meta(metas: Column, kind: str, attrs: dict[str, str], text: Column) -> Column:
    """The metas with one of that type in place of any that were there."""
    new = F.struct(F.lit(kind).alias("type"), F.map_from_arrays(F.array(*map(F.lit, attrs)), F.array(*map(F.lit, attrs.values()))).alias("attrs"), text.alias("text"))
    return F.concat(F.filter(metas, lambda m: m["type"] != kind), F.array(new))


def drop_meta(metas: Column, kind: str) -> Column:
    return F.filter(metas, lambda m: m["type"] != kind)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
