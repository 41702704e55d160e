"""Search over item tables: all matches, or each instance's first in document order."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.session import cut


def id_base(item_id: Column) -> Column:
    """An id without its trailing number and letter: ``tw-pos_b`` and ``tw-pos`` share a base."""
    return F.regexp_replace(F.regexp_replace(item_id, r"_[a-z]$", ""), r"\d+$", "")


def refers_to(expr: Column, item_id: str) -> Column:
    """Whether a reference expression points to an id, with or without a span."""
    return F.exists(T.parse_reference(expr), lambda r: r["id"] == item_id)


def where(id: str | None = None, type: str | None = None, base: str | None = None, attributes: dict[str, str] | None = None, content: str | None = None, segmentation: str | None = None, alignment: str | None = None, *others: Column) -> Column:
    """The conjunction of the given conditions; without any, everything matches."""
    parts = list(others)
    if id is not None:
        parts.append(F.col("item_id") == id)
    if type is not None:
        parts.append(F.col("tier_type") == type)
    if base is not None:
        parts.append(id_base(F.col("item_id")) == base)
    parts += [F.col(k) == v for k, v in (attributes or {}).items()]
    parts += [refers_to(F.col(k), v) for k, v in (("content", content), ("segmentation", segmentation), ("alignment", alignment)) if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find_all(items: DataFrame, condition: Column) -> DataFrame:
    return items.filter(F.coalesce(condition, F.lit(False)))


def find_first(items: DataFrame, condition: Column, order: list[str], key: str = "igt_id") -> DataFrame:
    """Each instance's first match."""
    columns = F.struct(*items.columns)
    return find_all(items, condition).groupBy(key).agg(F.min_by(columns, F.struct(*order)).alias("_r")).select("_r.*")


def follow(links: DataFrame, keys: list[str]) -> DataFrame:
    """(key.., item, target) for every chain of ``links(item, target)``, level by level until nothing is new."""
    step = links.select(*keys, F.col("item").alias("_i"), F.col("target").alias("_t"))
    now = out = cut(links.select(*keys, "item", "target").distinct())
    for d in itertools.count(2):
        now = cut(now.join(step.withColumnRenamed("_i", "target"), [*keys, "target"]).select(*keys, "item", F.col("_t").alias("target")).distinct().join(out, [*keys, "item", "target"], "left_anti"))
        if now.isEmpty():
            return out
        out = out.unionByName(now)
        if d % 16 == 0:
            out = cut(out)
