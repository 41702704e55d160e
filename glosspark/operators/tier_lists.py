"""Trees and phrase tiers as one list a row: what ``tiers`` does for tables, without any shuffle.

Column functions over lists of structs: the nodes of a bracketed text, the items of nodes, the nodes of items, the text of nodes. A task works
on all lists of an Arrow batch at once; the lists are told apart by the number of their row. Fields are those of ``tiers``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glosspark.session import ship, short_batches

NODES = "array<struct<node: int, parent: int, ord: int, label: string, depth: int, word_idx: int, word: string>>"
ITEMS = "array<struct<idx: int, item_id: string, text: string, alignment: string, children: string>>"
SPACE = r"[ \t\n\x0B\f\r]+"


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and all elements; a null list is empty."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _lists(rows: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.Array:
    """Elements in the order of their rows as one list a row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _ints(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=null)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, and where there is none."""
    return pc.fill_null(values, 0).cast(pa.int64()).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values at places; null where the place is negative."""
    return values.take(pa.array(at, mask=at < 0))


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    if by > 0:
        out[by:] = values[:-by]
    else:
        out[:by] = values[-by:]
    return out


def _rank(groups: np.ndarray) -> np.ndarray:
    """From 0, the place of each element in its group, for groups that stand together."""
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), at, 0)) if len(groups) else at


def _codes(*strings: pa.Array) -> list[np.ndarray]:
    """Equal numbers for equal strings of all arrays; -1 for null."""
    codes = pa.chunked_array([s.cast(pa.string()) for s in strings], pa.string()).combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    codes = pc.fill_null(codes.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(s) for s in strings])[:-1])


def _found(rows: np.ndarray, keys: np.ndarray, in_rows: np.ndarray, in_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (row, key) stands first in another list of them, -1 if nowhere, and how often; negative keys are nowhere."""
    span = max(keys.max(initial=0), in_keys.max(initial=0)) + 2
    held = np.flatnonzero(in_keys >= 0)
    have, want = in_rows[held] * span + in_keys[held], rows * span + keys
    order = np.argsort(have, kind="stable")
    have = have[order]
    first = np.searchsorted(have, want)
    times = np.where(keys >= 0, np.searchsorted(have, want, "right") - first, 0)
    at = np.full(len(want), -1)
    at[times > 0] = held[order[first[times > 0]]]
    return at, times


def parse(tokens: pa.Array) -> pa.Array:
    """Nodes of lists of brackets, labels and words: a bracket holds what stands one level deeper up to the next bracket of its own level."""
    n, (rows, toks) = len(tokens), _flat(tokens)
    opening, closing = (pc.equal(toks, x).to_numpy(zero_copy_only=False) for x in "()")
    starts = _rank(rows) == 0
    ends = np.concatenate([starts[1:], [True]])[: len(rows)]

    def running(x):  # sums from the start of a row
        total = np.cumsum(x)
        return total - np.repeat((total - x)[starts], np.diff(np.append(np.flatnonzero(starts), len(x))))

    word = ~opening & ~closing & ~(_shift(opening, 1) & ~starts)
    depth, node, place = running(opening.astype(np.int64) - closing), running(opening.astype(np.int64)), running(word.astype(np.int64))
    kept = np.flatnonzero(opening | word)
    row, opens, level = rows[kept], opening[kept], depth[kept] + ~opening[kept]
    # by row and level: what stands there, and the brackets that hold it
    holders = np.flatnonzero(opens)
    at = np.concatenate([np.arange(len(kept)), holders])
    holds = np.arange(len(at)) >= len(kept)
    low = level.min(initial=0)
    group = row[at] * (level.max(initial=0) - low + 2) + np.where(holds, level[at] + 1, level[at]) - low
    order = np.lexsort((at, group))
    last = np.maximum.accumulate(np.where(holds[order], np.arange(len(order)), -1)) if len(order) else order
    inside = last >= np.arange(len(order)) - _rank(group[order])
    parent = np.full(len(kept), -1)
    here = ~holds[order]
    parent[at[order[here]]] = np.where(inside, at[order[last]], -1)[here]
    group = np.where(parent >= 0, n + parent, row)
    order = np.argsort(group, kind="stable")
    nth, siblings = np.empty(len(kept), np.int64), np.bincount(group, minlength=1)[group]
    nth[order] = _rank(group[order]) + 1
    lone = np.flatnonzero(~opens & (siblings == 1) & (parent >= 0))
    words = np.where(opens, -1, kept)
    words[parent[lone]] = kept[lone]
    out = np.flatnonzero(opens | (siblings > 1))
    at, up, words = kept[out], parent[out], words[out]
    empty = opens[out] & ~ends[at] & _shift(opening | closing, -1)[at]
    label = _taken(toks, np.where(opens[out] & ~ends[at] & ~empty, at + 1, -1))
    fields = {
        "node": _ints(node[at], ~opens[out]), "parent": _ints(node[kept[up]], up < 0) if len(kept) else _ints(up), "ord": _ints(nth[out]),
        "label": pc.if_else(pa.array(empty), "", label), "depth": _ints(level[out]), "word_idx": _ints(place[words], words < 0) if len(kept) else _ints(up), "word": _taken(toks, words),
    }
    return _lists(row[out], n, fields)


def to_items(nodes: pa.Array, words: pa.Array, tier_id: str) -> pa.Array:
    """Items of nodes over words, preterminals first; none where a word stands beside other children or words are not as many as preterminals."""
    n, (rows, each), (word_rows, word) = len(nodes), _flat(nodes), _flat(words)
    n_words, loose = each.field("word_idx").is_valid().to_numpy(zero_copy_only=False), each.field("node").is_null().to_numpy(zero_copy_only=False)
    have = np.bincount(word_rows, minlength=n)
    fits = (np.bincount(rows[loose], minlength=n) == 0) & (np.bincount(rows[n_words], minlength=n) == have) & (have > 0)
    kept = np.flatnonzero(fits[rows])
    node, _ = _numbers(each.field("node").take(kept))
    kept = kept[np.lexsort((node, ~n_words[kept], rows[kept]))]
    rows, each = rows[kept], each.take(kept)
    idx = _rank(rows) + 1
    ids = pc.binary_join_element_wise(pa.scalar(tier_id), _ints(idx).cast(pa.string()), "")
    (node, _), (parent, root), (nth, _), (place, none) = (_numbers(each.field(x)) for x in ("node", "parent", "ord", "word_idx"))
    up, _ = _found(rows, np.where(root, -1, parent), rows, node)
    order = np.lexsort((nth, up))[np.count_nonzero(up < 0) :]
    count = np.bincount(up[order], minlength=len(rows))
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    below = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), ids.take(order)), " ")
    by, no = _numbers(word.field("idx"))
    to, _ = _found(rows, np.where(none, -1, place), word_rows, np.where(no, -1, by))
    fields = {"idx": _ints(idx), "item_id": ids, "text": each.field("label"), "alignment": _taken(word.field("item_id"), to), "children": _taken(below, np.where(count > 0, np.arange(len(rows)), -1))}
    return _lists(rows, n, fields)


def to_nodes(items: pa.Array, words: pa.Array) -> pa.Array:
    """Nodes of items over words; none where the items have a problem (``tiers.phrase_problems``) or one has no id."""
    n, (rows, each), (word_rows, word) = len(items), _flat(items), _flat(words)
    parents, below = _flat(pc.split_pattern_regex(pc.fill_null(each.field("children"), ""), pattern=SPACE))
    real = np.flatnonzero(pc.not_equal(below, "").to_numpy(zero_copy_only=False))
    parents, below = parents[real], below.take(real)
    ids, named = _codes(each.field("item_id"), below)
    aligned, word_ids = _codes(each.field("alignment"), word.field("item_id"))
    child, times = _found(rows[parents], named, rows, ids)
    to, hits = _found(rows, aligned, word_rows, word_ids)
    held, holds = np.bincount(child[child >= 0], minlength=len(rows)), np.bincount(parents, minlength=len(rows))
    bad = np.zeros(n, bool)
    bad[rows[parents[times != 1]]] = True
    bad[rows[(ids < 0) | (_found(rows, ids, rows, ids)[1] > 1) | (held > 1) | ((aligned >= 0) == (holds > 0)) | ((aligned >= 0) & (hits != 1))]] = True
    bad |= np.bincount(rows[held == 0], minlength=n) != 1
    # down by levels, sizes back up, then places in pre-order: a child stands behind its parent and the earlier children with all they hold
    first = np.cumsum(holds) - holds
    up, nth, depth = np.full(len(rows), -1), np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
    level, levels = np.flatnonzero((held == 0) & ~bad[rows]), []
    while len(level):
        levels.append(level)
        depth[level] = len(levels)
        count = holds[level]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        after = child[np.repeat(first[level], count) + place]
        up[after], nth[after] = np.repeat(level, count), place + 1
        level = after
    size, node = np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, up[level], size[level])
    for level in levels[1:]:
        before = np.cumsum(size[level]) - size[level]
        node[level] = node[up[level]] + 1 + before - before[np.arange(len(level)) - nth[level] + 1]
    kept = np.flatnonzero(depth)
    kept = kept[np.lexsort((node[kept], rows[kept]))]
    over, at = up[kept], to[kept]
    fields = {
        "node": _ints(node[kept]), "parent": _ints(node[over], over < 0) if len(kept) else _ints(over), "ord": _ints(nth[kept]), "label": each.field("text").take(kept),
        "depth": _ints(depth[kept]), "word_idx": _taken(word.field("idx").cast(pa.int32()), at), "word": _taken(word.field("tok"), at),
    }
    return _lists(rows[kept], n, fields)


def to_text(nodes: pa.Array) -> pa.Array:
    """The bracketed texts of lists of nodes in pre-order, null for an empty one: a node closes as many brackets as the next one stands higher, and one more."""
    n, (rows, each) = len(nodes), _flat(nodes)
    depth, _ = _numbers(each.field("depth"))
    last = np.concatenate([rows[1:] != rows[:-1], [True]])[: len(rows)]
    closed = np.maximum(depth - np.where(last, 1, _shift(depth, -1)) + 1, 0)
    word = pc.fill_null(pc.binary_join_element_wise(" ", each.field("word"), ""), "")
    text = pc.binary_join_element_wise("(", each.field("label"), word, pc.binary_repeat(pa.array([")"] * len(rows), pa.string()), pa.array(closed)), "")
    kept = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
    count = np.bincount(rows[kept], minlength=n)
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return _taken(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text.take(kept)), " "), np.where(count > 0, np.arange(n), -1))


def _column(work: Callable, kind: str, *columns: Column) -> Column:
    spark = SparkSession.active()
    ship(spark)
    short_batches(spark)
    return F.arrow_udf(work, kind)(*columns)


def tokens(tree: Column) -> Column:
    """Brackets, labels and words of a bracketed text."""
    return F.regexp_extract_all(tree, F.lit(r"\(|\)|[^\s()]+"), 0)


def parsed(tree: Column) -> Column:
    """The nodes of a bracketed text (``tiers.parsed``)."""

    def work(toks: pa.Array) -> pa.Array:
        return parse(toks)

    return _column(work, NODES, tokens(tree))


def phrase_items(nodes: Column, words: Column, tier_id: str) -> Column:
    """The items of nodes over words ``(idx, item_id, ..)`` (``tiers.phrase_items``)."""

    def work(nodes: pa.Array, words: pa.Array) -> pa.Array:
        return to_items(nodes, words, tier_id)

    return _column(work, ITEMS, nodes, words)


def phrase_nodes(items: Column, words: Column) -> Column:
    """The nodes of items over words ``(idx, item_id, tok)`` (``tiers.phrase_nodes``)."""

    def work(items: pa.Array, words: pa.Array) -> pa.Array:
        return to_nodes(items, words)

    return _column(work, NODES, items, words)


def tree_items(tree: Column, words: Column, tier_id: str) -> Column:
    """The items of a bracketed text over words: ``parsed`` and ``phrase_items`` at once."""

    def work(toks: pa.Array, words: pa.Array) -> pa.Array:
        return to_items(parse(toks), words, tier_id)

    return _column(work, ITEMS, tokens(tree), words)


def reread(tree: Column, words: Column, tier_id: str) -> Column:
    """The text that a bracketed text has after it became items over words and these were read back; null where there is no tree.

    ``tree_items``, ``phrase_nodes`` and ``tiers.brackets`` in one task, between which no list leaves Python.
    """

    def work(toks: pa.Array, words: pa.Array) -> pa.Array:
        return to_text(to_nodes(to_items(parse(toks), words, tier_id), words))

    return _column(work, "string", tokens(tree), words)
