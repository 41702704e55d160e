"""Trees as tables and as tiers: bracketed texts, node tables, phrase-structure and dependency items, and back.

A node table ``(key.., node, parent, ord, label, depth, word_idx, word)`` has a row per labelled node, numbered from 1 in pre-order; the root
has no parent, a preterminal has its word. A tier's items name each other by ids: ``children`` of a phrase, ``alignment`` of
a preterminal to its word, ``dep`` and ``head`` of a dependency. A phrase tree is one list a row while it is worked on (``tier_lists``), so
that its depth costs no joins; other steps are windows and joins over whole tables. Places below dependencies need one join a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.operators import tier_lists
from glosspark.session import cut, wide

PHRASES, DEPENDENCIES = "ps", "ds"  # fixed values of the format: bases of tier ids


def _by(keys: list[str], *more: str) -> str:
    return ", ".join([f"`{k}`" for k in keys] + list(more))


def _together(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row a key, its rows in a list; merged when joined, never broadcast."""
    return wide(rows.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys))).alias(name)))


def _apart(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.select(*keys, F.inline(name))


def parsed(trees: DataFrame, keys: list[str], tree: str = "tree") -> DataFrame:
    """Node tables of bracketed trees ``(S (NP (DT The) ...))``; a node whose bracket is followed by another has the label ''.

    A word directly under a node that has other children is a row without a label.
    """
    return _apart(trees.select(*keys, tier_lists.parsed(F.col(tree)).alias("_nodes")), keys, "_nodes")


def brackets(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., tree)``: the bracketed text of each node table.

    In pre-order a preterminal closes as many brackets as the next node stands higher, and one more.
    """
    rows = nodes.selectExpr(*(f"`{k}`" for k in keys), "node", "label", "word", "depth", f"coalesce(lead(depth) OVER (PARTITION BY {_by(keys)} ORDER BY node), 1) AS next")
    closed = F.col("depth") - F.col("next") + 1
    text = F.concat(F.lit("("), "label", F.when(F.col("word").isNotNull(), F.concat(F.lit(" "), "word")).otherwise(""), F.repeat(F.lit(")"), closed.cast("int")))
    return rows.select(*keys, "node", text.alias("text")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), " ").alias("tree"))


def phrase_items(nodes: DataFrame, words: DataFrame, keys: list[str], tier_id: str = PHRASES) -> DataFrame:
    """``(key.., tier_id, idx, item_id, text, alignment, children)`` of node tables over ``words(key.., idx, item_id)``.

    Preterminals come first, aligned to their words, then phrases with the ids of their children; ids are the tier's with the item's
    place. Instances whose preterminals are not as many as their words, or that have a word beside other children, get no tier.
    """
    nodes = nodes.select(*keys, *(F.col(x).cast("int").alias(x) for x in ("node", "parent", "ord", "word_idx")), "label")
    both = _together(nodes, keys, "_nodes").join(_together(words.select(*keys, F.col("idx").cast("int").alias("idx"), "item_id"), keys, "_words"), keys)
    items = both.select(*keys, tier_lists.phrase_items(F.col("_nodes"), F.col("_words"), tier_id).alias("_items"))
    return _apart(items, keys, "_items").select(*keys, F.lit(tier_id).alias("tier_id"), "idx", "item_id", "text", "alignment", "children")


def paths(links: DataFrame, keys: list[str]) -> DataFrame:
    """``links(key.., item, parent, ord)`` with ``path``, the places from the root down, for what hangs from a root (parent null).

    One join a level, until a level is empty; a link is followed once, so a ring that hangs nowhere gets no path.
    """
    rest = cut(links.select(*keys, "item", "parent", "ord"))
    level = cut(rest.filter("parent IS NULL").withColumn("path", F.array("ord")))
    found = [level]
    while True:
        above = level.select(*keys, F.col("item").alias("parent"), F.col("path").alias("up"))
        level = rest.join(above, [*keys, "parent"]).select(*keys, "item", "parent", "ord", F.concat("up", F.array("ord")).alias("path"))
        level = cut(level.join(reduce(DataFrame.unionByName, found).select(*keys, "item", "parent", "ord"), [*keys, "item", "parent", "ord"], "left_anti"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)


def _child_links(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.select(*keys, F.col("item_id").alias("parent"), F.posexplode(F.filter(F.split(F.coalesce("children", F.lit("")), r"\s+"), lambda x: x != "")).alias("i", "item")).select(*keys, "item", "parent", (F.col("i") + 1).alias("ord"))


def phrase_problems(items: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., problem)`` of phrase tiers that are no tree: missing child, two parents, several roots, no root, no children, no word, both;
    same id, no id, two words: what an id stands for is open."""
    links = _child_links(items, keys)
    lack = lambda df, name: df.select(*keys, F.lit(name).alias("problem"))
    known = items.select(*keys, F.col("item_id").alias("item"))
    roots = known.join(links, [*keys, "item"], "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))
    word = words.select(*keys, F.col("item_id").alias("alignment"))
    has = links.select(*keys, F.col("parent").alias("item_id")).distinct()
    found = [
        lack(links.join(known, [*keys, "item"], "left_anti"), "missing child"),
        lack(links.groupBy(*keys, "item").agg(F.count("*").alias("n")).filter("n > 1"), "two parents"),
        lack(roots.filter("n > 1"), "several roots"),
        lack(items.select(*keys).distinct().join(roots, keys, "left_anti"), "no root"),
        lack(items.filter("alignment IS NULL").join(has, [*keys, "item_id"], "left_anti"), "no children"),
        lack(items.filter("alignment IS NOT NULL").join(word, [*keys, "alignment"], "left_anti"), "no word"),
        lack(items.filter("alignment IS NOT NULL").join(has, [*keys, "item_id"], "left_semi"), "both"),
        lack(items.filter("item_id IS NOT NULL").groupBy(*keys, "item_id").agg(F.count("*").alias("n")).filter("n > 1"), "same id"),
        lack(items.filter("item_id IS NULL"), "no id"),
        lack(items.join(word.groupBy(*keys, "alignment").agg(F.count("*").alias("n")).filter("n > 1"), [*keys, "alignment"], "left_semi"), "two words"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def phrase_nodes(items: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Node tables of phrase tiers ``items(key.., item_id, text, alignment, children)`` over ``words(key.., idx, item_id, tok)``.

    Tiers with a problem (``phrase_problems``) give none.
    """
    both = _together(items.select(*keys, "item_id", "text", "alignment", "children"), keys, "_items").join(_together(words.select(*keys, "idx", "item_id", "tok"), keys, "_words"), keys)
    return _apart(both.select(*keys, tier_lists.phrase_nodes(F.col("_items"), F.col("_words")).alias("_nodes")), keys, "_nodes")


def dependency_items(edges: DataFrame, words: DataFrame, keys: list[str], tier_id: str = DEPENDENCIES) -> DataFrame:
    """``(key.., tier_id, idx, item_id, text, dep, head)`` of ``edges(key.., dep, head, type)`` over words; an edge from the root 0 has no head.

    Items stand in the order of a walk from the root that takes dependents by their place; edges that do not hang from the root give none.
    """
    own = edges.select(*keys, F.col("dep").alias("d"), F.greatest("head", F.lit(0)).alias("p"), "type").distinct()
    links = own.select(*keys, F.col("d").alias("item"), F.when(F.col("p") > 0, F.col("p")).alias("parent"), F.col("d").alias("ord")).distinct()
    placed = paths(links, keys).groupBy(*keys, F.col("item").alias("d"), F.coalesce("parent", F.lit(0)).alias("p")).agg(F.min("path").alias("path"))  # a word of several heads: its edge below each
    rows = own.join(placed, [*keys, "d", "p"])
    place = F.expr(f"row_number() OVER (PARTITION BY {_by(keys)} ORDER BY path, type)")
    of = lambda at, name: words.select(*keys, F.col("idx").cast("int").alias(at), F.col("item_id").alias(name))
    rows = rows.join(of("d", "dep"), [*keys, "d"]).join(of("p", "head"), [*keys, "p"], "left").withColumn("idx", place)
    return rows.select(*keys, F.lit(tier_id).alias("tier_id"), "idx", F.concat(F.lit(tier_id), F.col("idx").cast("string")).alias("item_id"), F.col("type").alias("text"), "dep", "head")


def dependency_edges(items: DataFrame, words: DataFrame, keys: list[str], tags: DataFrame | None = None) -> DataFrame:
    """``(key.., dep, head, type, word, pos)`` of dependency items; ``pos`` is the label that ``tags(key.., idx, label)`` has for the word."""
    of = lambda name, at, *more: words.select(*keys, F.col("item_id").alias(name), F.col("idx").alias(at), *more)
    rows = items.join(of("dep", "d", F.col("tok").alias("word")), [*keys, "dep"]).join(of("head", "h"), [*keys, "head"], "left")
    rows = rows.filter("head IS NULL OR h IS NOT NULL").select(*keys, F.col("d").cast("int").alias("dep"), F.coalesce(F.col("h").cast("int"), F.lit(0)).alias("head"), F.col("text").alias("type"), "word").distinct()
    if tags is None:
        return rows.withColumn("pos", F.lit(None).cast("string"))
    return rows.join(tags.select(*keys, F.col("idx").alias("dep"), F.col("label").alias("pos")), [*keys, "dep"], "left").select(*keys, "dep", "head", "type", "word", "pos")


def loose_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that do not hang from the root 0."""
    links = edges.select(*keys, F.col("dep").alias("item"), F.when(F.col("head") > 0, F.col("head")).alias("parent"), F.col("dep").alias("ord")).distinct()
    held = paths(links, keys).select(*keys, F.col("item").alias("dep"), F.coalesce("parent", F.lit(0)).alias("head"))
    return edges.join(held, [*keys, "dep", "head"], "left_anti")


def nearest_aligned(tokens: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., idx, left, right)``: the aligned places nearest to each token (``idx``) that ``covered(key.., idx)`` lacks; null where there is none."""
    rows = tokens.select(*keys, "idx").distinct().join(covered.select(*keys, "idx").distinct().withColumn("at", F.col("idx")), [*keys, "idx"], "left")
    order = f"(PARTITION BY {_by(keys)} ORDER BY idx"
    rows = rows.selectExpr(*(f"`{k}`" for k in keys), "idx", "at", f"last(at, true) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS `left`", f"first(at, true) OVER {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS `right`")
    return rows.filter("at IS NULL").drop("at")


def attached(edges: DataFrame, tokens: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """``(key.., dep, head)``: where unaligned tokens hang (Quirk et al. 2005).

    Between two aligned words: from the lower word of the edge around the token that is closest to it (ties by the edge's words); outside: from the
    first or last aligned word. A token between words without an edge around it hangs nowhere and has no row.
    """
    lone = nearest_aligned(tokens, covered, keys)
    outer = lone.filter("`left` IS NULL OR `right` IS NULL").select(*keys, F.col("idx").alias("dep"), F.coalesce("left", "right").alias("head")).filter("head IS NOT NULL")
    inner = lone.filter("`left` IS NOT NULL AND `right` IS NOT NULL").join(edges.select(*keys, F.col("dep").alias("d"), F.col("head").alias("h")), keys)
    around = inner.filter("(h < idx AND idx < d) OR (d < idx AND idx < h)").withColumn("far", F.abs(F.col("idx") - F.col("h")) + F.abs(F.col("idx") - F.col("d")))
    nearest = around.groupBy(*keys, "idx").agg(F.min_by("d", F.struct("far", "h", "d")).alias("head"))
    return outer.unionByName(nearest.select(*keys, F.col("idx").alias("dep"), "head"))
