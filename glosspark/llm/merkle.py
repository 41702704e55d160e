"""Merkle manifest of a dataset by fractal traversal.

Each row is a leaf, H (SHA-256, lower-case hex) of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. In a source the leaves ascend by doc_id; every ``FAN`` = 16 consecutive nodes (a last run may have fewer)
become the H of their concatenated hex digests, until one is left, the subroot. Subroots in the order of their sources
(null first, bytewise) become the root alike.

Nodes are numbered over sampled ranges and gathered in aligned blocks of ``BLOCK`` = 256, two levels of runs, so a hot source is
many blocks and no task holds more than a block at a time. A block's top goes up as a node of the next pass, 256
times fewer a pass. Down again, every block is traversed once: for each level the run that holds the current leaf (the
existing subtree) stays, while the next one (the desired subtree) grows by a leaf at each step out of a stack of unfinished runs, so that
successive authentication paths come out with memory linear in the levels. The path above the block, one per block, is joined and appended.

Defined results: null and empty values are told apart (``-`` and ``0:``); a null doc_id comes before all others; rows of equal
doc_id follow their leaf digests, repeated rows are leaves of their own with proofs of their own; a very long text is one leaf like any other;
an empty table has no subroot and no root; a lone leaf is its subroot, a lone subroot the root, and a proof without siblings is
the H of nothing; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches
from glosspark.llm.order import numbered
from glosspark.session import cut

FAN = 16
HEIGHT = 2
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<pos int, siblings array<string>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(**changed: Column) -> Column:
    """The digest of a row, as 32 bytes; ``changed`` gives other values for columns."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def digest(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class Subtree:
    """Nodes of one height out of leaves handed in one after another; it holds one unfinished run for each height below."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []

    def add(self, node: str, last: bool) -> None:
        """One more leaf; the last one closes all that is unfinished."""
        for run in self.open:
            run.append(node)
            if len(run) < FAN and not last:
                return
            node = digest(run)
            run.clear()
        self.nodes.append(node)


def grown(leaves: list[str], height: int, total: int) -> list[str]:
    """The nodes of a height over the first of ``total`` leaves."""
    tree = Subtree(height)
    for i, x in enumerate(leaves):
        tree.add(x, i == total - 1)
    return tree.nodes


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[list[str], int]]]:
    """For each leaf in turn its run and the place in it, from the lowest level up."""
    n = len(leaves)
    span = [FAN ** (level + 1) for level in range(height)]
    existing = [grown(leaves[: span[level]], level, n) for level in range(height)]
    desired = [Subtree(level) for level in range(height)]
    for j in range(n):
        yield [(existing[level], j % span[level] * FAN // span[level]) for level in range(height)]
        for level in range(height):
            ahead = j + span[level]
            if ahead < n:
                desired[level].add(leaves[ahead], ahead == n - 1)
            if (j + 1) % span[level] == 0:
                existing[level], desired[level] = desired[level].nodes, Subtree(level)


def height_of(m: int) -> int:
    """Levels of a block in a tree of ``m`` nodes."""
    return next((h for h in range(HEIGHT) if m <= FAN**h), HEIGHT)


def in_blocks(nodes: DataFrame) -> DataFrame:
    """``(key, m, block, items)`` of ``nodes(key, idx, m, item)``, items in the order of idx."""
    rows = nodes.groupBy("key", "m", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "item"))).alias("rows"))
    return rows.select("key", "m", "block", F.transform("rows", lambda x: x["item"]).alias("items"))


def _top(digests: pa.Array, m: pa.Array) -> pa.Array:
    out = []
    for d, n in zip(digests.to_pylist(), m.to_pylist()):
        h = height_of(n)
        out.append(bytes.fromhex(grown([x.hex() for x in d], h, len(d))[0]))
    return pa.array(out, pa.binary())


_top.__annotations__ = {"digests": pa.Array, "m": pa.Array, "return": pa.Array}


def paths(blocks: DataFrame) -> DataFrame:
    """``(key, idx, <fields of an item>, path)`` for every node of ``blocks(key, m, block, items, up)``: its path with ``up`` behind it."""
    fields = blocks.schema["items"].dataType.elementType.fields

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("siblings", pa.list_(pa.string()))]))
        for batch in batches:
            items, ups = batch.column("items"), batch.column("up")
            for i, (m, block) in enumerate(zip(batch.column("m").to_pylist(), batch.column("block").to_pylist())):
                own = items[i].values
                leaves, up = [x.hex() for x in own.field("digest").to_pylist()], ups[i].as_py()
                found = [[{"pos": pos, "siblings": nodes[:pos] + nodes[pos + 1 :]} for nodes, pos in path] + up for path in traverse(leaves, height_of(m))]
                columns = [batch.column("key").take(pa.array([i] * len(own))), pa.array(range(block * BLOCK, block * BLOCK + len(own)), pa.int64()), *(own.field(f.name) for f in fields), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "idx", *(f.name for f in fields), "path"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return blocks.select("key", "m", "block", "items", "up").mapInArrow(run, f"key string, idx bigint, {ddl}, path {PATH}")


def climb(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, root)``, and ``(key, block, up)``: the path from each block's top to its root."""
    tops = blocks.select("key", F.col("block").alias("idx"), F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("m"), F.arrow_udf(_top, "binary")(F.transform("items", lambda x: x["digest"]), F.col("m")).alias("digest"))
    tops = cut(tops)
    if tops.filter("m > 1").isEmpty():
        return tops.select("key", F.col("digest").alias("root")), tops.select("key", F.col("idx").alias("block"), F.array().cast(PATH).alias("up"))
    above = cut(in_blocks(tops.select("key", "idx", "m", F.struct("digest").alias("item"))))
    roots, up = climb(above)
    return roots, cut(paths(above.join(up, ["key", "block"])).select("key", F.col("idx").alias("block"), F.col("path").alias("up")))


def _forest(docs: DataFrame, carry: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of leaves, the path from each block's top to its subroot, and ``(key, subroot, n_leaves, up, root)``."""
    set_batches(docs.sparkSession)
    own = docs.select(*(F.col(f"`{c}`") for c in FIELDS))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # null first
    leaves = own.select(key.alias("key"), "doc_id", leaf().alias("digest"), *(c.alias(name) for name, c in carry.items()))
    placed = numbered(cut(leaves), "key", ["doc_id", "digest"])  # sampling the ranges would read and hash all texts once more
    blocks = cut(in_blocks(placed.select("key", "idx", "m", F.struct("doc_id", "digest", *carry).alias("item"))))
    subroots, up = climb(blocks)
    sizes = blocks.select(F.col("key").alias("of"), F.col("m").alias("n_leaves")).distinct()
    sources = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("digest")), "key", ["of"])
    sources = cut(in_blocks(sources.select("key", "idx", "m", F.struct("of", "digest").alias("item"))))
    root, over = climb(sources)
    sources = paths(sources.join(over, ["key", "block"])).join(root, "key").join(sizes, "of")
    return blocks, up, cut(sources.select(F.col("of").alias("key"), F.col("digest").alias("subroot"), "n_leaves", F.col("path").alias("over"), "root"))


def hexed(value: str) -> Column:
    return F.lower(F.hex(value))


def _source(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(key, 2, 1 << 30))


def manifest(docs: DataFrame) -> DataFrame:
    """``(source, n_leaves, subroot, root)``, a row per source."""
    return _forest(docs, {})[2].select(_source("key").alias("source"), "n_leaves", hexed("subroot").alias("subroot"), hexed("root").alias("root"))


def proofs(docs: DataFrame, **carry: Column) -> DataFrame:
    """``(doc_id, source, leaf, path, subroot, root)`` and the columns ``carry`` of every row.

    ``path`` holds for each level, from the leaf up, the siblings in its run and the place among them.
    """
    blocks, up, sources = _forest(docs, {f"carry_{c}": x for c, x in carry.items()})
    tops = up.join(sources.select("key", "over"), "key").select("key", "block", F.concat("up", "over").alias("up"))
    out = paths(blocks.join(tops, ["key", "block"])).join(sources.select("key", "subroot", "root"), "key")
    return out.select("doc_id", _source("key").alias("source"), hexed("digest").alias("leaf"), "path", hexed("subroot").alias("subroot"), hexed("root").alias("root"), *(F.col(f"carry_{c}").alias(c) for c in carry))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and its path give."""

    def step(node: Column, x: Column) -> Column:
        left, right = F.slice(x["siblings"], 1, x["pos"]), F.slice(x["siblings"], x["pos"] + 1, F.size(x["siblings"]) + 1)
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(path, start, step)


def proof_digest(path: Column) -> Column:
    """H of all siblings."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda x: x["siblings"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, with the roots that they give after tampering: where 5 divides the unsigned crc32 of the decimal doc_id, A-Z of the text are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = proofs(docs, changed=F.when(hit, leaf(text=F.translate("text", UPPER, LOWER))))
    rows = rows.withColumn("folded_root", fold(F.coalesce(hexed("changed"), "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT b::UINTEGER AS b, list_reduce(list_prepend(b::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b)),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits),
parts AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0
                 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM documents, crc),
pre AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM parts),
leaves AS (SELECT doc_id, coalesce('s' || source, '') AS k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS leaf2 FROM pre),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
lower_(k, lvl, idx, d, m) AS (SELECT k, 0, idx, leaf, count(*) OVER (PARTITION BY k) FROM placed
    UNION ALL SELECT k, any_value(lvl) + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)), any_value((m + 15) // 16) FROM lower_ WHERE m > 1 GROUP BY k, idx // 16),
sub AS (SELECT k, d AS subroot, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS m FROM lower_ WHERE m = 1),
upper_(lvl, idx, d, m) AS (SELECT 0, idx, subroot, m FROM sub
    UNION ALL SELECT any_value(lvl) + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)), any_value((m + 15) // 16) FROM upper_ WHERE m > 1 GROUP BY idx // 16),
runs AS (SELECT k, lvl, idx // 16 AS run, list(d ORDER BY idx) AS nodes FROM lower_ WHERE m > 1 GROUP BY ALL),
tops AS (SELECT lvl, idx // 16 AS run, list(d ORDER BY idx) AS nodes FROM upper_ WHERE m > 1 GROUP BY ALL),
steps AS (SELECT p.k, p.idx, lvl AS lvl, p.idx // (16 ** lvl)::BIGINT % 16 AS pos, nodes FROM placed p JOIN runs r ON r.k = p.k AND r.run = p.idx // (16 ** (lvl + 1))::BIGINT
    UNION ALL SELECT p.k, p.idx, 1000 + lvl, s.idx // (16 ** lvl)::BIGINT % 16, nodes FROM placed p JOIN sub s USING (k) JOIN tops t ON t.run = s.idx // (16 ** (lvl + 1))::BIGINT),
path AS (SELECT k, idx, list({'pos': pos, 'nodes': nodes} ORDER BY lvl) AS path FROM steps GROUP BY k, idx),
done AS (SELECT p.*, subroot, (SELECT d FROM upper_ WHERE m = 1) AS root, coalesce(path, []) AS path FROM placed p JOIN sub USING (k) LEFT JOIN path h ON h.k = p.k AND h.idx = p.idx),
walk(k, idx, hop, node) AS (SELECT k, idx, 0, leaf2 FROM done
    UNION ALL SELECT w.k, w.idx, hop + 1, sha256(array_to_string(path[hop + 1].nodes[:path[hop + 1].pos], '') || node || array_to_string(path[hop + 1].nodes[path[hop + 1].pos + 2:], '')) FROM walk w JOIN done d ON w.k = d.k AND w.idx = d.idx WHERE hop < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: array_to_string(x.nodes[:x.pos] || x.nodes[x.pos + 2:], '')), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM done d JOIN walk w ON w.k = d.k AND w.idx = d.idx AND hop = len(path)
"""
