r"""Source divergence audit over mergeable radix tries.

Terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased: runs of ASCII letters and of all that is not ASCII, so a text is
read as UTF-8 bytes. Every partition counts the terms of its texts and brings them into one byte trie a language, whose leaves hold the
documents and the occurrences by source. At ``CELLS`` counters the tries leave the task as their traversals and new ones are begun, so memory is
bounded. What leaves is dealt out by language and the first ``PREFIX`` = 3 bytes, and sorted, so that the traversals of one range of prefixes run
together and are merged leaf by leaf. A common word is one row for each trie, not for each occurrence.

Terms in at least ``MIN_DOCS`` = 30 documents of a language are kept. With V kept terms of a language and N occurrences of them in a source,
a term with n of these has p = 1 + floor(10**9 * (n + 5) / (N + 5 * V)), in exact decimal arithmetic. A last traversal
in the order of UTF-8 streams the kept terms: it sums |p - p'| of each two sources of a language and holds for each source the ``TOP`` = 50
terms of the greatest p - q over the language's own q, equal values by their order in the traversal. Only sums and these lists leave
the task.

Defined results: null lang, source and text are ''; a source without terms has N = 0 and takes part in all pairs; a language without
kept terms has pairs of value 0; repeated rows count as often as they stand; ties are ordered by item; an empty table
gives an empty table; very long texts are read in pieces that end between terms; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import long_batches, set_batches, slices
from glosspark.llm.tries import Trie
from glosspark.session import cut

TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
MIN_DOCS, TOP = 30, 50
CELLS = 1 << 20  # some 300 MB of a worker
PREFIX = 3
PIECE = 1 << 22
ROWS = 1 << 13
SMALL = 5000  # sources over all languages, of some ten bytes each, that are broadcast
SALTS = 64
LEAVES = "lang string, term binary, docs bigint, counts binary"  # counts: packed, as most leaves are too rare to be read again
KEPT = "lang string, term binary, docs bigint, sources array<string>, ns array<bigint>"
SCALE, PRIOR = 10**9, 5


def pieces(raw: bytes, at: int, stop: int):
    """Terms of the bytes from ``at`` to ``stop``, lower-cased already, some ``PIECE`` bytes at a time."""
    while at < stop:
        end = min(at + PIECE, stop)
        if end < stop:
            found = BREAK.search(raw, end, stop)
            end = found.start() if found else stop
        yield TERM.findall(raw, at, end)
        at = end


def packed(counts: dict[str, int]) -> bytes:
    """Each count, the length of its source, and the source."""
    return "".join([f"{n}:{len(s)}:{s}" for s, n in counts.items()]).encode()


def unpacked(data: bytes):
    text, at = data.decode(), 0
    while at < len(text):
        n, size, rest = text[at:].split(":", 2)
        at = len(text) - len(rest) + int(size)
        yield rest[: int(size)], int(n)


def _batched(leaves, last: str, column):
    """Record batches of (lang, term, docs, counts); ``column`` makes what follows the first three of a batch's counts."""
    for held in iter(lambda: list(islice(leaves, ROWS)), []):
        lang, term, docs, counts = zip(*held)
        more = column(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.binary()), pa.array(docs, pa.int64()), *more], ["lang", "term", "docs", *last.split()])


def _leaves(leaves):
    return _batched(leaves, "counts", lambda counts: [pa.array(list(map(packed, counts)), pa.binary())])


def _lists(counts) -> list[pa.Array]:
    ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, counts)))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(values, kind)) for values, kind in (([x for c in counts for x in c], pa.string()), ([n for c in counts for n in c.values()], pa.int64()))]


class Counting:
    """A task's counters until they fill its tries."""

    def __init__(self) -> None:
        self.words: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[str, Counter] = defaultdict(Counter)

    def text(self, lang: str, source: str, raw: bytes, at: int, stop: int) -> None:
        own, seen = self.words[lang, source], set()
        for terms in pieces(raw, at, stop):
            own.update(terms)
            seen.update(terms)
        self.docs[lang].update(seen)

    def full(self) -> bool:
        return sum(map(len, self.words.values())) >= CELLS

    def leave(self):
        """All that was counted, in the order of the tries; the counters are empty afterwards."""
        gc.disable()  # nodes hold no cycles, and looking for some takes most of the time
        try:
            yield from _leaves((lang, *x) for lang, trie in self.tries() for x in trie.leaves())
        finally:
            gc.enable()
        self.words.clear()
        self.docs.clear()

    def tries(self):
        for lang, docs in sorted(self.docs.items(), key=lambda x: x[0].encode()):
            by_term: dict[bytes, dict[str, int]] = {}
            for (own, source), words in self.words.items():
                if own == lang:
                    for term, n in words.items():
                        if term in by_term:
                            by_term[term][source] = n
                        else:
                            by_term[term] = {source: n}
            trie = Trie()
            for term, counts in by_term.items():
                leaf = trie.leaf(term)
                leaf.docs, leaf.counts = docs[term], counts
            yield lang, trie


def counted(docs: DataFrame) -> DataFrame:
    """Leaves of the partitions' tries over ``docs(lang, source, text)``."""

    def run(batches):
        held = Counting()
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            first = 0
            for offsets, data in slices(batch.column("text")):
                raw = data.tobytes().lower()
                for key, at, stop in zip(keys[first:], offsets[:-1].tolist(), offsets[1:].tolist()):
                    held.text(*key, raw, at, stop)
                first += len(offsets) - 1
                if held.full():
                    yield from held.leave()
        yield from held.leave()

    return docs.mapInArrow(run, LEAVES)


def merged(leaves: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One leaf for each (lang, term) in at least ``min_docs`` documents, in order within ranges."""

    def whole(table: pa.RecordBatch, starts: np.ndarray):
        """Leaves of the groups of rows that begin at ``starts``, if they are in enough documents."""
        docs = np.add.reduceat(table.column("docs").to_numpy(), starts)
        size = np.diff(np.append(starts, table.num_rows))
        keep = np.flatnonzero(docs >= min_docs)
        rows = np.repeat(starts[keep] - np.cumsum(size[keep]) + size[keep], size[keep]) + np.arange(size[keep].sum())
        own = iter(table.column("counts").take(pa.array(rows)).to_pylist())
        heads = table.take(pa.array(starts[keep]))
        for lang, term, n, k in zip(heads.column("lang").to_pylist(), heads.column("term").to_pylist(), docs[keep].tolist(), size[keep].tolist()):
            counts: dict[str, int] = {}
            for data in islice(own, k):
                for source, m in unpacked(data):
                    counts[source] = counts.get(source, 0) + m
            yield lang, term, n, counts

    def groups(batches):
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.concat_batches([rest, batch])
            if not table.num_rows:
                continue
            differ = [pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False) for x in (table.column("lang"), table.column("term"))]
            starts = np.concatenate([[0], np.flatnonzero(differ[0] | differ[1]) + 1])
            last = int(starts[-1])  # its group may go on in the next batch
            rest = table.slice(last)
            if last:
                yield from whole(table.slice(0, last), starts[:-1])
        if rest is not None:
            yield from whole(rest, np.zeros(1, np.int64))

    def run(batches):
        yield from _batched(groups(batches), "sources ns", _lists)

    prefix = F.substring("term", 1, PREFIX)
    return leaves.repartition("lang", prefix).sortWithinPartitions("lang", "term").mapInArrow(run, KEPT)


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term, exact for counts up to 10**18."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total + PRIOR * terms)) + 1


def sources_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, v, total, groups)``: kept terms, their occurrences, and each source with its own, in order."""
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.ns").alias("n"))
    known = docs.select("lang", "source").distinct().join(cells, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    langs = known.groupBy("lang").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    return langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))


def with_shares(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, term, q, ps)``: p of every source of the language, negative where it lacks the term.

    The sources are broadcast up to ``SMALL`` of them, else salted, so that a language with many terms is dealt out.
    """
    if langs.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()[0] <= SMALL:
        rows = kept.join(F.broadcast(langs), "lang")
    else:
        salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    own = rows.withColumn("n_of", F.map_from_arrays("sources", "ns")).withColumn("n", F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, x: a + x))

    def one(g: Column) -> Column:
        n = F.try_element_at("n_of", g["source"])
        return F.when(n.isNull(), -share(F.lit(0).cast("bigint"), g["n"], F.col("v"))).otherwise(share(n, g["n"], F.col("v")))

    return own.select("lang", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("q"), F.transform("groups", one).alias("ps"))


def traversed(shares: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, a, b, term, value)``: sums of |p - p'| of sources a and b (places from 1), and each task's best terms of a source (b null)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        best: dict[str, list[tuple[np.ndarray, list[bytes]]]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            cuts = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])) if len(langs) else []
            for at, stop in zip(cuts, [*cuts[1:], len(langs)]):
                lang, own = langs[at], batch.slice(at, stop - at)
                signed = own.column("ps").flatten().to_numpy().reshape(stop - at, -1)
                p, q, terms = np.abs(signed), own.column("q").to_numpy(), own.column("term")
                size = p.shape[1]
                if lang not in sums:
                    sums[lang], best[lang] = np.zeros((size, size), np.int64), [(np.zeros(0, np.int64), []) for _ in range(size)]
                for a in range(size):
                    sums[lang][a] += np.abs(p - p[:, a : a + 1]).sum(0)
                    rows = np.flatnonzero((signed[:, a] > q))  # negative where the source lacks the term
                    gain = p[rows, a] - q[rows]
                    first = np.argsort(-gain, kind="stable")[:top]
                    value, names = best[lang][a]
                    value, names = np.concatenate([value, gain[first]]), names + terms.take(pa.array(rows[first])).to_pylist()
                    order = np.argsort(-value, kind="stable")[:top]  # what came first stands first among equals
                    best[lang][a] = value[order], [names[i] for i in order]
        for lang, matrix in sums.items():
            found = [(lang, a + 1, b + 1, None, int(v)) for a, row in enumerate(matrix) for b, v in enumerate(row) if a != b]
            found += [(lang, a + 1, None, t, int(v)) for a, (value, names) in enumerate(best[lang]) for v, t in zip(value, names)]
            for i in range(0, len(found), ROWS):
                columns = zip(*found[i : i + ROWS])
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "a", "b", "term", "value"])

    return shares.sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, a int, b int, term binary, value bigint")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source's distance to the others of its language, and its overused terms."""
    spark = docs.sparkSession
    set_batches(spark)
    own = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("`text`").alias("text"))
    leaves = counted(own)
    with long_batches(spark, ROWS):
        kept = cut(merged(leaves, min_docs))
        langs = cut(sources_of(own, kept))
        found = cut(traversed(with_shares(kept, langs), top))
    name = lambda c: F.element_at("groups", F.col(c))["source"]
    sums = found.filter("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = langs.select("lang", "groups", F.posexplode("groups").alias("i", "g")).select("lang", "groups", (F.col("i") + 1).alias("a"), F.posexplode("groups").alias("j", "h"))
    pairs = pairs.select("lang", "a", (F.col("j") + 1).alias("b"), name("a").alias("source"), F.col("h.source").alias("item")).filter("a <> b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)")
    best = found.filter("b IS NULL").withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, a ORDER BY value DESC, term)")).filter(F.col("rank") <= top)
    terms = best.join(langs.select("lang", "groups"), "lang").select("lang", name("a").alias("source"), F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.withColumn("rank", place).unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY 1, 2),
p AS (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5) // (total + 5 * v)) AS p
      FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
q AS (SELECT n.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY n.lang) + 5 * any_value(v))) AS q FROM n JOIN v USING (lang) GROUP BY n.lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""
