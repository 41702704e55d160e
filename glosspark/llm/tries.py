"""Radix tries over bytes whose leaves count a term's documents and its occurrences by source."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix


class Trie:
    """A node: edges by their first byte, each a label of one or more bytes and the node below; counters where a term ends."""

    __slots__ = ("edges", "docs", "counts")

    def __init__(self, docs: int = 0, counts: dict[str, int] | None = None) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] | None = None
        self.docs = docs
        self.counts = counts

    def leaf(self, term: bytes) -> Trie:
        """The node at which ``term`` ends; an edge that it leaves half-way is split."""
        node, at, end = self, 0, len(term)
        while at < end:
            edges, first = node.edges, term[at]
            if edges is None:
                edges = node.edges = {}
            found = edges.get(first)
            if found is None:
                child = Trie()
                edges[first] = (term[at:], child)
                return child
            label, child = found
            if len(label) > 1 and not term.startswith(label, at):
                shared = len(commonprefix((label, term[at : at + len(label)])))
                middle = Trie()
                middle.edges = {label[shared]: (label[shared:], child)}
                edges[first] = (label[:shared], middle)
                label, child = label[:shared], middle
            node, at = child, at + len(label)
        return node

    def add(self, term: bytes, docs: int, counts: dict[str, int]) -> None:
        """Add a term's counters."""
        leaf = self.leaf(term)
        leaf.docs += docs
        if leaf.counts is None:
            leaf.counts = counts
        else:
            own = leaf.counts = dict(leaf.counts)
            for source, n in counts.items():
                own[source] = own.get(source, 0) + n

    def merge(self, other: Trie) -> None:
        """Add all that ``other`` counts."""
        for x in other.leaves():
            self.add(*x)

    def leaves(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """(term, documents, occurrences by source) in the order of the bytes, which for UTF-8 is that of the code points."""
        open_ = [(b"", self)]
        while open_:
            prefix, node = open_.pop()
            if node.counts is not None:
                yield prefix, node.docs, node.counts
            if node.edges:
                for first in sorted(node.edges, reverse=True):
                    label, child = node.edges[first]
                    open_.append((prefix + label, child))
