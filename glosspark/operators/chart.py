"""Parsing by a probabilistic grammar that is read off trees: counts of rules and words as tables, the best tree by a chart.

A grammar is two tables, ``rules(lhs, rhs, p)`` with the children joined by blanks, and ``words(tag, word, p)``. Rules of more than two children
are split from the left into rules of two over auxiliary symbols, which never show in a tree. Both tables are bounded by ``RULES`` and
``WORDS`` rows, checked before they become constants of the plan; sentences are parsed in Arrow batches, span by span from short to long.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.session import ship

RULES, WORDS = 200_000, 1_000_000
JOIN = "\x1f"


def grammar(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Relative frequencies of rules and words in node tables (``tiers.parsed``)."""
    own = nodes.filter("node IS NOT NULL")
    children = own.filter("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), " ").alias("rhs"))
    rules = own.select(*keys, "node", F.col("label").alias("lhs")).join(children, [*keys, "node"]).groupBy("lhs", "rhs").agg(F.count("*").alias("n"))
    words = own.filter("word IS NOT NULL").groupBy(F.col("label").alias("tag"), F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    share = lambda df, by: df.withColumn("p", F.expr(f"n / sum(n) OVER (PARTITION BY {by})")).drop("n")
    return share(rules, "lhs"), share(words, "tag")


class Chart:
    """A grammar as look-ups, and the best derivation of each symbol over each span."""

    def __init__(self, rules: list[tuple[str, str, float]], words: list[tuple[str, str, float]]):
        self.single: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.double: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
        self.tags: dict[str, list[tuple[str, float]]] = defaultdict(list)
        seen = set()
        for lhs, rhs, p in rules:
            parts = rhs.split(" ")
            if len(parts) == 1:
                self.single[parts[0]].append((lhs, math.log(p)))
                continue
            rest = parts[1] if len(parts) == 2 else JOIN.join(parts[1:])
            self.double[parts[0]].append((rest, lhs, math.log(p)))
            for k in range(1, len(parts) - 2 + 1):
                name = JOIN.join(parts[k:])
                if len(parts) - k > 1 and name not in seen:
                    seen.add(name)
                    self.double[parts[k]].append((JOIN.join(parts[k + 1 :]), name, 0.0))
        total: dict[str, float] = defaultdict(float)
        for tag, word, p in words:
            self.tags[word].append((tag, math.log(p)))
            total[tag] += 1
        kinds = sum(total.values()) or 1.0  # an unknown word takes a tag by the number of its words
        self.unknown = [(t, math.log(n / kinds) - math.log(kinds)) for t, n in sorted(total.items())]

    def close(self, cell: dict) -> None:
        """Add what single-child rules give, until nothing gets better."""
        agenda = sorted(cell)
        while agenda:
            child = agenda.pop()
            for lhs, p in self.single.get(child, ()):
                score = cell[child][0] + p
                if lhs not in cell or score > cell[lhs][0] + 1e-12:
                    cell[lhs] = (score, child, None)
                    agenda.append(lhs)

    def parse(self, words: list[str], roots: tuple[str, ...]) -> tuple[float, str] | None:
        n = len(words)
        cells: dict[tuple[int, int], dict] = {}
        for i, w in enumerate(words):
            cells[i, i + 1] = {t: (p, None, None) for t, p in self.tags.get(w.lower(), self.unknown)}
            self.close(cells[i, i + 1])
        for size in range(2, n + 1):
            for a in range(n - size + 1):
                b = a + size
                cell: dict = {}
                for m in range(a + 1, b):
                    left, right = cells[a, m], cells[m, b]
                    for x, (px, *_) in left.items():
                        for y, lhs, p in self.double.get(x, ()):
                            if y in right:
                                score = px + right[y][0] + p
                                if lhs not in cell or score > cell[lhs][0]:
                                    cell[lhs] = (score, (x, y), m)
                self.close(cell)
                cells[a, b] = cell
        if not n:
            return None
        found = [(cells[0, n][r][0], r) for r in roots if r in cells[0, n]]
        if not found:
            return None
        score, root = max(found, key=lambda x: (x[0], x[1]))
        return score, " ".join(self.brackets(cells, words, root, 0, n))

    def brackets(self, cells: dict, words: list[str], symbol: str, a: int, b: int) -> list[str]:
        _, made, m = cells[a, b][symbol]
        if made is None:
            inner = [words[a]]
        elif m is None:
            inner = self.brackets(cells, words, made, a, b)
        else:
            inner = self.brackets(cells, words, made[0], a, m) + self.brackets(cells, words, made[1], m, b)
        return inner if JOIN in symbol else [f"({symbol} {' '.join(inner)})"]


def parse(sentences: DataFrame, rules: DataFrame, words: DataFrame, roots: tuple[str, ...] = ("S",)) -> DataFrame:
    """``sentences(.., words array<string>)`` with ``tree`` and ``log_p``, null where the grammar has no tree; brackets in words become -LRB- and -RRB-."""
    ship(sentences.sparkSession)
    held = []
    for df, most in ((rules.select("lhs", "rhs", "p"), RULES), (words.select("tag", "word", "p"), WORDS)):
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a grammar of more than {most} rows")
        held.append(sorted(tuple(r) for r in rows))
    made: list[Chart] = []
    own, wide = [c for c in sentences.columns if c not in ("tree", "log_p")], sentences.withColumn("row", F.struct("*"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not made:
                made.append(Chart(*held))
            out = []
            for ws in batch.column("words").to_pylist():
                got = made[0].parse([w.replace("(", "-LRB-").replace(")", "-RRB-") for w in ws or ()], roots)
                out.append(got or (None, None))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for _, t in out], pa.string()), pa.array([p for p, _ in out], pa.float64())], ["row", "tree", "log_p"])

    schema = wide.select("row").schema.add("tree", "string").add("log_p", "double")
    return wide.select("row", "words").mapInArrow(run, schema).select(*(F.col(f"row.`{c}`").alias(c) for c in own), "tree", "log_p")
