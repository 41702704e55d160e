"""Near duplicates by word shingles: a Jaccard similarity of ``SIMILARITY`` = 0.8 or more over sets of five-word shingles.

A text's set holds the XXH64 values (seed 42) of its five-word shingles, A-Z lower-cased; a text of fewer words has one
shingle of all its words, a text of none the empty set. Equal sets are one node from the start. Candidates come from
``simhash``: nodes of equal fingerprints, and those that its anchors link within 3 bits. At a similarity of 0.8 some ten
bits differ, which no covering reaches without most anchors; so nodes that share one of ``BANDS`` = 24 bands of ``ROWS`` = 5
minhashes are candidates too: a pair at similarity 0.8 is missed with a probability of 0.00007, at 0.9 of less than 1e-9.
Every candidate is verified on the sets themselves, so no link is below the threshold.

In a band of at most ``SMALL`` = 8 nodes all pairs are candidates. The nodes of larger bands are gathered in clusters, the components of
(node, first node of a large band), and in a cluster all pairs are compared, blocks of ``BLOCK_BYTES`` by blocks, a task for two blocks: first by
signature (one byte of each of the 120 minhashes; a pair goes on that agrees in ``AGREE`` = 76 or more, which one at similarity 0.8
misses with a probability of 0.000003), then, most alike first and only while the two are not linked yet, on the sets. What leaves the task is a
forest, linear in the nodes. So no link is given up for the size of a group; comparisons of signatures grow with the square of a
cluster of texts that are near but not equal.

Defined results: null and empty texts are linked with each other; rows repeat as they were given; an empty table gives an
empty table; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import long_batches, set_batches, text_udf
from glosspark.llm.components import components
from glosspark.llm.rows import field, packed, unpacked
from glosspark.llm.simhash import links, majority
from glosspark.session import cut

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, SMALL = 24, 5, 8
AGREE = 76  # of BANDS * ROWS bytes
BLOCK_BYTES = 4 << 20
CELLS = 1 << 25  # bytes compared at a time
BLOCK = 1 << 12  # shingles at a time
_RNG = np.random.default_rng(SEED)
_MIX = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split()  # bytes: A-Z, and blank, \t \n \v \f \r only
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)][: len(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))


def signatures(offsets: np.ndarray, data: np.ndarray) -> dict:
    """Of each row the digest of its set, its fingerprint, then its bands; and the signature."""
    raw, out, sign = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        h = shingle_set(raw[a:b])
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), BLOCK):
            mixed = h[at : at + BLOCK, None] * _MIX + _ADD
            low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(0))
        bands = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))]
        out.append(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED), majority(h), *bands], np.uint64))
        sign.append((low * _MIX >> np.uint64(56)).astype(np.uint8).tobytes())
    return {"s": _lists(out), "sign": sign}


def sets(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return _lists([shingle_set(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])


def pairs_of(band: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each band of rows sorted by band, for bands of at most SMALL nodes."""
    cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    place, found = np.arange(len(band)) - np.repeat(cuts, np.diff(np.append(cuts, len(band)))), []
    for lag in range(1, SMALL):
        at = np.flatnonzero(place >= lag)
        found.append((at - lag, at))
    u, v = (node[np.concatenate(x)] for x in zip(*found))
    return np.minimum(u, v), np.maximum(u, v)


def shared_bands(nodes: DataFrame) -> DataFrame:
    """``(band, node, n, first)`` of bands that two or more nodes have, with their number and the smallest."""
    placed = nodes.select("node", F.explode("bands").alias("band"))
    sums = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1")
    return placed.join(sums, "band")


def band_pairs(shared: DataFrame) -> DataFrame:
    """``(u, v)`` of nodes that share a small band."""

    def meet(batches):
        rest = None
        for batch in batches:
            g, k = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("band", "node"))
            if rest is not None:
                g, k = (np.concatenate(x) for x in zip(rest, (g, k)))
            whole = int(np.flatnonzero(g != g[-1])[-1]) + 1 if len(g) and (g != g[-1]).any() else 0  # the last band may go on
            rest = (g[whole:], k[whole:])
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(g[:whole], k[:whole])], ["u", "v"])
        if rest is not None and len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(*rest)], ["u", "v"])

    small = shared.filter(F.col("n") <= SMALL).select("band", "node")
    return small.repartition("band").sortWithinPartitions("band").mapInArrow(meet, "u bigint, v bigint")


def linked(sign: np.ndarray, sets_of: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links between rows ``first`` and rows ``second``, or among them if they are the same."""
    size = np.array([len(x) for x in sets_of])
    found, step = [], max(1, CELLS // max(1, len(second) * sign.shape[1]))
    for at in range(0, len(first), step):
        own = first[at : at + step]
        agree = (sign[own, None, :] == sign[None, second, :]).sum(2, dtype=np.uint8)
        least, most = np.minimum(size[own, None], size[second]), np.maximum(size[own, None], size[second])
        i, j = np.nonzero((agree >= AGREE) & (least >= SIMILARITY * most))
        a, b = own[i], second[j]
        keep = a < b if first is second else slice(None)
        found.append((agree[i, j][keep], a[keep], b[keep]))
    agree, a, b = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-agree.astype(np.int16), kind="stable")
    root = list(range(len(size)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u, v in zip(a[order].tolist(), b[order].tolist()):
        p, q = top(u), top(v)
        if p != q:
            n = len(np.intersect1d(sets_of[u], sets_of[v], assume_unique=True))
            if n >= SIMILARITY * (size[u] + size[v] - n):
                root[max(p, q)] = min(p, q)
                out.append((u, v))
    return out


def cluster_links(shared: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """``(u, v)``: verified links that span all links within the clusters of large bands."""
    stars = shared.filter((F.col("n") > SMALL) & (F.col("node") != F.col("first"))).select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    rows = components(stars).join(nodes.select("node", "sign"), "node").join(held, "node")
    blocks = rows.groupBy("root").agg(F.ceil(F.sum(F.size("set") * 8 + BANDS * ROWS) / BLOCK_BYTES).cast("int").alias("b"))
    rows = rows.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "sign", "set")

    def compare(table: pa.Table) -> pa.Table:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(node), -1)
        lists = table.column("set").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first = np.flatnonzero(own == i)
        found = linked(sign, [flat[a:b] for a, b in zip(at[:-1], at[1:])], first, first if i == j else np.flatnonzero(own == j)) if len(first) else []
        pairs = node[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"u": pa.array(pairs.min(1) if len(pairs) else pairs[:, 0]), "v": pa.array(pairs.max(1) if len(pairs) else pairs[:, 1])})

    return rows.groupBy("root", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``(u, v)`` of ``nodes(node, fp)``: equal fingerprints by their first node, and the first nodes of linked ones."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.join(first, "fp").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = links(first.select("fp"))
    u, v = (first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "uv")
    return equal.unionByName(near.join(u, "u").join(v, "v").select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))).filter("u <> v")


def row_key(id: str, h: str) -> Column:
    """A row's id and text hash as one join key of one type on either side: nulls in it are equal, and grouping by it after the join deals no text out again."""
    return F.struct(F.when(F.col(id).isNotNull(), F.col(id)).alias("id"), F.coalesce(h, F.lit(0).cast("bigint")).alias("h"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: that of the smallest doc_id (nulls last), then of the smallest text hash."""
    spark = docs.sparkSession
    set_batches(spark)
    keyed = packed(docs).withColumn("id", field(docs, "doc_id")).withColumn("h", F.xxhash64("text"))
    placed = keyed.withColumn("key", row_key("id", "h"))
    marked = cut(keyed.select("id", "h", text_udf(signatures, "s array<bigint>, sign binary")(F.col("text")).alias("x")).select("id", "h", "x.*"))
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("best")
    nodes = cut(marked.groupBy(F.col("s")[0].alias("node")).agg(best, F.first(F.col("s")[1]).alias("fp"), F.first(F.slice("s", 3, BANDS)).alias("bands"), F.first("sign").alias("sign")))
    shared = cut(shared_bands(nodes))
    with long_batches(spark):
        found = cut(band_pairs(shared).unionByName(fingerprint_pairs(nodes.select("node", "fp"))).distinct())
    met = found.select(F.col("u").alias("node")).union(found.select("v")).union(shared.filter(F.col("n") > SMALL).select("node")).distinct()
    met = nodes.join(met, "node").select("node", row_key("best.id", "best.h").alias("key"))
    texts = placed.select("key", "text").join(met, "key").dropDuplicates(["key"])
    held = cut(texts.select("node", text_udf(sets, "array<bigint>")(F.col("text")).alias("set")))
    both = found.join(held.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    same = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("of"))
    near = same.filter(F.col("n") >= SIMILARITY * (F.col("of") - F.col("n"))).select("u", "v")
    roots = components(near.unionByName(cluster_links(shared, nodes, held)))
    rooted = nodes.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("b")).select(row_key("b.id", "b.h").alias("key"))
    return placed.select("key", "row", "text").join(stay, "key", "left_semi").dropDuplicates(["key"]).select(*unpacked(docs))
