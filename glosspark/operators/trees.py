"""Phrase-structure and dependency trees: readers, writers, node and edge tables, projection across alignments.

A phrase structure is a nested list ``Node``; a dependency structure is a list of edges (dep, head, type). Depth, span and
reachability run as joins over node and edge tables; projection is recursive by nature and runs per instance in Arrow batches.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.session import cut, ship


class Node:
    """A labelled ordered tree; a leaf has a word index and no children."""

    __slots__ = ("label", "children", "index", "parent")

    def __init__(self, label: str, children: Iterable[Node] = (), index: int | None = None):
        self.label, self.index, self.parent = label, index, None
        self.children: list[Node] = []
        for child in children:
            self.insert(len(self.children), child)

    def insert(self, at: int, child: Node) -> None:
        child.parent = self
        self.children.insert(at, child)

    def leaves(self) -> list[Node]:
        return [self] if self.index is not None else [x for c in self.children for x in c.leaves()]

    @property
    def is_preterminal(self) -> bool:
        return len(self.children) == 1 and self.children[0].index is not None

    def preterminals(self) -> list[Node]:
        return [self] if self.is_preterminal else [x for c in self.children for x in c.preterminals()]

    def span(self) -> tuple[int, int]:
        at = [x.index for x in self.leaves()]
        return min(at), max(at)

    def root(self) -> Node:
        return self if self.parent is None else self.parent.root()

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def remove(self, prune: bool = True) -> None:
        """Take the node out; with ``prune`` also ancestors that it leaves empty."""
        p = self.parent
        if p is None:
            return
        p.children.remove(self)
        self.parent = None
        if prune and not p.children:
            p.remove()

    def promote(self) -> None:
        """Put the node's children in its place."""
        p, at = self.parent, self.parent.children.index(self)
        p.children[at : at + 1] = self.children
        for c in self.children:
            c.parent = p
        self.parent, self.children = None, []

    def copy(self) -> Node:
        return Node(self.label, [c.copy() for c in self.children], self.index)

    def __str__(self) -> str:
        return self.label if self.index is not None else f"({self.label} {' '.join(map(str, self.children))})"


def parse_brackets(text: str) -> Node:
    """``(S (NP (DT The) ...))``; words are numbered from 1."""
    stack: list[Node] = [Node("")]
    count = 0
    parts = re.findall(r"\(|\)|[^\s()]+", text)
    fresh = False
    for part in parts:
        if part == "(":
            node = Node("")
            stack[-1].insert(len(stack[-1].children), node)
            stack.append(node)
            fresh = True
        elif part == ")":
            stack.pop()
            fresh = False
        elif fresh:
            stack[-1].label, fresh = part, False
        else:
            count += 1
            stack[-1].insert(len(stack[-1].children), Node(part, index=count))
    top = stack[0].children[0]
    top.parent = None
    return top


def _order(node: Node) -> bool:
    """One change that brings two children of ``node`` nearer to word order; False if there is none."""
    kids = node.children
    spans = [k.span() for k in kids]
    for i in range(len(kids)):
        for j in range(i + 1, len(kids)):
            (a, b), (c, d) = spans[i], spans[j]
            x, y = kids[i], kids[j]
            if b < c:
                continue
            if (a, b) == (c, d):
                if x.is_preterminal and y.is_preterminal:
                    x.label = f"{x.label}+{y.label}"
                    y.remove(prune=False)
                else:
                    for k in (x, y):
                        if not k.is_preterminal:
                            k.promote()
            elif a > c and b > d:
                kids[i], kids[j] = y, x
            elif a < c and b > d:
                x.promote()
            elif a > c and b < d:
                y.promote()
            else:
                for k in (x, y):
                    if not k.is_preterminal:
                        k.promote()
            return True
    return False


def reorder(root: Node) -> None:
    """Swap, merge and promote until every node's children stand in word order without overlap."""
    while any(_order(n) for n in list(root.walk()) if len(n.children) > 1):
        pass


def _insert_by_span(node: Node, new: Node) -> None:
    at = new.span()[0]
    place = next((i for i, c in enumerate(node.children) if c.span()[0] > at), len(node.children))
    node.insert(place, new)


def project_phrases(source: str, words: list[str], pairs: Iterable[tuple[int, int]]) -> str | None:
    """The bracketed tree over ``words`` (target side) that a source tree and (source, target) pairs give; None without pairs."""
    pairs = sorted({(s, t) for s, t in pairs if s > 0 and t > 0}, key=lambda p: (p[1], p[0]))
    if not pairs:
        return None
    tree = parse_brackets(source)
    by_source = defaultdict(list)
    for s, t in pairs:
        by_source[s].append(t)
    for pre in tree.preterminals():
        s = pre.children[0].index
        if s not in by_source:
            pre.remove()
            continue
        parent, at = pre.parent, pre.parent.children.index(pre)
        parent.children.pop(at)
        for k, t in enumerate(by_source[s]):
            parent.insert(at + k, Node(pre.label, [Node(words[t - 1], index=t)]))
    reorder(tree)
    covered = sorted({t for _, t in pairs})
    for t in range(1, len(words) + 1):
        if t in covered:
            continue
        new = Node("UNK", [Node(words[t - 1], index=t)])
        left, right = [c for c in covered if c < t], [c for c in covered if c > t]
        pres = {p.children[0].index: p for p in tree.preterminals()}
        if left and right:
            above = lambda n: [] if n.parent is None else [n.parent, *above(n.parent)]
            others = {id(x) for x in above(pres[right[0]])}
            host = next(x for x in above(pres[left[-1]]) if id(x) in others)
        else:
            host = pres[right[0] if right else left[-1]].parent
        _insert_by_span(host, new)
    return str(tree)


def parse_dependencies(text: str) -> list[tuple[int, int, str, str]]:
    """(dep, head, type, word) from ``type(head-i, dep-j)``, from CoNLL rows, or from ``(word[i] (child[j]))``; repeats dropped."""
    if re.search(r"\w+\(\S+-\d+'*,\s*\S+-\d+'*\)", text):
        found = [(int(d), int(h), t, w) for t, h, w, d in re.findall(r"([\w:.]+)\(\S+-(\d+)'*,\s*(\S+)-(\d+)'*\)", text)]
    elif "\t" in text or re.match(r"\s*\d+\s+\S+\s+\S+\s+\S+", text):
        rows = [r.split() for r in text.strip().splitlines() if r.strip()]
        found = [(int(r[0]), int(r[6]), r[7], r[1]) for r in rows]
    else:
        found, stack = [], []
        for opened, word, at, closed in re.findall(r"(\()|([^\s()\[\]]+)\[(\d+)\]|(\))", text):
            if word:
                if stack:
                    found.append((int(at), stack[-1], "", word))
                stack.append(int(at))
            elif closed and stack:
                stack.pop()
            del opened
    return list(dict.fromkeys(found))


def reachable(edges: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Edges in the order in which they hang together from the root 0; an edge off the tree raises."""
    by_head = defaultdict(list)
    for e in edges:
        by_head[e[1]].append(e)
    out, queue, used = [], [0], set()
    while queue:
        for e in by_head.pop(queue.pop(0), ()):
            if e not in used:
                used.add(e)
                out.append(e)
                queue.append(e[0])
    if len(out) < len(set(edges)):
        raise ValueError("edges that do not hang from the root")
    return out


def project_dependencies(edges: list[tuple[int, int, str, str]], words: list[str], pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Edges over ``words`` from source edges and (source, target) pairs.

    Unaligned source words leave, their children move up; a source word's targets are siblings, the first takes its children; of
    a target's copies the one nearest the root stays; unaligned targets hang from the lower word of the closest edge
    around them, or from the outermost aligned word (Quirk et al. 2005).
    """
    pairs = sorted({(s, t) for s, t in pairs if s > 0 and t > 0})
    if not pairs:
        return []
    targets = defaultdict(list)
    for s, t in pairs:
        targets[s].append(t)
    children = defaultdict(list)
    for d, h, kind, _ in reachable(edges):
        children[h].append((d, kind))
    placed: list[tuple[int, int, int, str]] = []  # depth, target, head, type

    def hang(s: int, head: int, depth: int, seen: frozenset) -> None:
        for d, kind in sorted(children[s]):
            if d in seen:
                continue
            if d in targets:
                for t in targets[d]:
                    placed.append((depth, t, head, kind))
                hang(d, targets[d][0], depth + 1, seen | {d})
            else:
                hang(d, head, depth, seen | {d})

    hang(0, 0, 1, frozenset())
    best: dict[int, tuple[int, int, int, str]] = {}
    for p in sorted(placed, key=lambda p: p[0]):
        best.setdefault(p[1], p)
    above = {t: (p[2], p[3]) for t, p in best.items()}
    for t in list(above):  # a head whose own copy stands elsewhere is the same word; a loop goes to the root
        seen, h = {t}, above[t][0]
        while h and h not in seen and h in above:
            seen.add(h)
            h = above[h][0]
        if h in seen and h:
            above[t] = (0, above[t][1])
    aligned = sorted({t for _, t in pairs})
    more = []
    for j in range(1, len(words) + 1):
        if j in aligned:
            continue
        left, right = [i for i in aligned if i < j], [k for k in aligned if k > j]
        if not left or not right:
            more.append((j, right[0] if right else left[-1]))
            continue
        around = [(abs(j - h) + abs(j - d), h, d) for d, (h, _) in above.items() if h < j < d or d < j < h]
        if around:
            more.append((j, min(around, key=lambda x: x[0])[2]))
    for j, h in more:
        if h in above:
            above[j] = (h, "")
    return sorted((t, h, kind, words[t - 1]) for t, (h, kind) in above.items())


def conll(edges: list[tuple[int, int, str, str]]) -> str:
    """Ten tab-separated columns a word, the smallest head where there are several; ``root`` under 0."""
    by = {}
    for d, h, kind, word in sorted(edges):
        by.setdefault(d, (h, kind, word))
    return "\n".join("\t".join([str(d), word, "_", "_", "_", "_", str(h), "root" if h == 0 else kind or "_", "_", "_"]) for d, (h, kind, word) in by.items())


def stanford(edges: list[tuple[int, int, str, str]]) -> str:
    names = {d: word for d, _, _, word in edges} | {0: "ROOT"}
    return "\n".join(f"{kind or 'dep'}({names.get(h, '?')}-{h}, {word}-{d})" for d, h, kind, word in edges)


def _batches(df: DataFrame, work, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [x for r in pdf.itertuples(index=False) for x in work(r)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return df.mapInPandas(run, schema)


def project_phrase_table(rows: DataFrame) -> DataFrame:
    """``(igt_id, tree, words, pairs array<struct<src,tgt>>)`` to ``(igt_id, tree)``; instances without pairs give no row."""
    kind = rows.schema["igt_id"].dataType.simpleString()

    def work(r):
        out = project_phrases(r.tree, list(r.words), [(p["src"], p["tgt"]) for p in r.pairs])
        return [] if out is None else [(r.igt_id, out)]

    return _batches(rows.select("igt_id", "tree", "words", "pairs"), work, f"igt_id {kind}, tree string")


def project_dependency_table(rows: DataFrame) -> DataFrame:
    """``(igt_id, edges, words, pairs)`` with textual edges to ``(igt_id, dep, head, type, word)``."""
    kind = rows.schema["igt_id"].dataType.simpleString()

    def work(r):
        got = project_dependencies(parse_dependencies(r.edges), list(r.words), [(p["src"], p["tgt"]) for p in r.pairs])
        return [(r.igt_id, *e) for e in got]

    return _batches(rows.select("igt_id", "edges", "words", "pairs"), work, f"igt_id {kind}, dep int, head int, type string, word string")


def nodes(rows: DataFrame) -> DataFrame:
    """``(igt_id, tree)`` to ``(igt_id, node_id, parent_id, ord, label, leaf_idx)`` in pre-order."""
    kind = rows.schema["igt_id"].dataType.simpleString()

    def work(r):
        tree = parse_brackets(r.tree)
        number = {id(n): i for i, n in enumerate(tree.walk(), 1)}
        return [(r.igt_id, number[id(n)], number.get(id(n.parent)), n.parent.children.index(n) + 1 if n.parent else 1, n.label, n.index) for n in tree.walk()]

    return _batches(rows.select("igt_id", "tree"), work, f"igt_id {kind}, node_id int, parent_id int, ord int, label string, leaf_idx int").withColumn("parent_id", F.col("parent_id"))


def productions(node_table: DataFrame) -> DataFrame:
    """``label -> children`` rules with counts, from a node table."""
    p = node_table.filter("leaf_idx IS NULL").select("igt_id", F.col("node_id").alias("parent_id"), F.col("label").alias("lhs"))
    j = node_table.join(p, ["igt_id", "parent_id"]).groupBy("igt_id", "parent_id", "lhs").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), " ").alias("rhs"))
    return j.groupBy(F.concat_ws(" -> ", "lhs", "rhs").alias("rule")).agg(F.count("*").alias("n"))


def depths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(key.., dep, depth) of every edge's shallowest way from the root 0, level by level until a level is empty."""
    e = edges.select(*keys, "dep", "head").distinct()
    level = cut(e.filter("head = 0").select(*keys, "dep", F.lit(1).alias("depth")).distinct())
    out = level
    for d in itertools.count(2):
        level = cut(e.join(level.select(*keys, F.col("dep").alias("head")), [*keys, "head"]).select(*keys, "dep", F.lit(d).alias("depth")).distinct().join(out, [*keys, "dep"], "left_anti").select(*keys, "dep", "depth"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if d % 16 == 0:
            out = cut(out)
