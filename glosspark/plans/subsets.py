"""Subsets of a corpus as plans: instances that fulfil requirements, and parts for training, tuning and testing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.operators import corpus

KEYS = ["igt_id"]


def filtered(raw: DataFrame, lines: list[str] = ("L", "G", "T"), links: DataFrame | None = None, gloss_tags: DataFrame | None = None, even: bool = False) -> DataFrame:
    """``raw(igt_id, ord, tag, text, ..)`` of the instances that have all ``lines``, a link, a gloss tag, and with ``even`` as many gloss as language words.

    A requirement that is not given does not count; a line without words is none.
    """
    held = raw.filter(F.size(T.words("text")) > 0)
    instances = corpus.require_lines(raw.select(*KEYS).distinct(), held, list(lines))
    for layer in (links, gloss_tags):
        if layer is not None:
            instances = instances.join(layer, KEYS, "left_semi")
    if even:
        main = F.split_part("tag", F.lit("+"), F.lit(1))
        n = held.groupBy(*KEYS).agg(*(F.sum(F.when(main == t, F.size(T.words("text")))).alias(t) for t in "LG")).filter("L = G")
        instances = instances.join(n, KEYS, "left_semi")
    return raw.join(instances, KEYS, "left_semi")


def split(raw: DataFrame, train: float = 0.8, dev: float = 0.1, tag: str = "L") -> DataFrame:
    """``raw`` with ``part``, whole instances dealt out in the order of igt_id by the words of their ``tag`` lines."""
    main = F.split_part("tag", F.lit("+"), F.lit(1))
    sizes = raw.groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(main == tag, F.size(T.words("text")))), F.lit(0)).alias("n"))
    parts = corpus.split(sizes, KEYS, train, dev).select(*KEYS, "part")
    return raw.drop("part").join(parts, KEYS)
