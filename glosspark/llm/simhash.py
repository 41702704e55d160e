"""SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 majority bits over the XXH64 values (seed 42) of a text's word shingles. Fingerprints link at
``THRESHOLD`` = 3 or fewer differing bits. Of the two 32-bit halves of a linked pair at least one differs in at most
one bit, so each half is covered on its own: the anchors are the codewords of the perfect Hamming(31, 26) code with one
free bit beside it, whose covering radius is 1. Every half has one home anchor within the radius, and is replicated to
all anchors within radius plus threshold (1 + 1): at most 17. A linked pair meets at the home anchor of either partner,
so comparing homes with members of each anchor loses no link, and two fingerprints share one of 2**27 anchors by
chance only. Equal fingerprints are one node from the start, so groups of copies do not grow an anchor.

Inside an anchor the members are compared in blocks; the links found are reduced to a spanning forest before they
leave the task, so output is linear in the members. Components come from star contractions.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; rows repeat as they were
given; a component of null ids has a null component_id; an empty table gives an empty table; extra columns
are ignored.
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
from glosspark.session import cut

THRESHOLD = 3
SEED = 42
BLOCK = 1 << 20  # comparisons at a time


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half the values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint_slice(offsets: np.ndarray, data: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each row as a signed 64-bit integer."""
    raw = data.tobytes().lower()  # bytes: A-Z only
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = raw[a:b].split()  # bytes: blank, \t \n \v \f \r only
        if len(words) < shingle:
            grams, n = [b" ".join(words)], min(len(words), 1)
        else:
            grams, n = map(b" ".join, zip(*(words[k:] for k in range(shingle)))), len(words) - shingle + 1
        if n:
            out[i] = majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, a BIGINT that holds the 64 bits."""
    set_batches(docs.sparkSession)
    return docs.withColumn("fp", text_udf(lambda o, d: fingerprint_slice(o, d, shingle), "bigint")(F.col(text)))


def _bit(position: Column) -> Column:
    return F.expr("1L") if position is None else F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def anchors(fps: DataFrame) -> DataFrame:
    """``(anchor, fp, home)``: every fingerprint at its home anchors and at all others in reach, for either half."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)]
    halves = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("half"), x.alias("word")) for k, x in enumerate((F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)))))).alias("h")).select("fp", "h.*")
    parity = sum(((F.bit_count(F.col("word").bitwiseAND(m)) % 2) * (1 << b) for b, m in enumerate(masks)), F.lit(0))
    s = halves.withColumn("s", parity.cast("int"))
    free = F.lit(1 << 31).cast("bigint")
    home = F.when(F.col("s") == 0, F.col("word")).otherwise(F.expr("word ^ shiftleft(1L, s - 1)"))
    two = F.expr("transform(filter(sequence(1, 31), i -> s <> 0 AND (i ^ s) > i), i -> word ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
    reach = s.select("fp", "half", home.alias("home"), two.alias("two"))
    all_of = F.concat(F.array(F.struct(F.col("home").alias("a"), F.lit(True).alias("home")), F.struct(F.col("home").bitwiseXOR(free).alias("a"), F.lit(False).alias("home"))), F.transform("two", lambda x: F.struct(x.alias("a"), F.lit(False).alias("home"))))
    return reach.select("fp", "half", F.explode(all_of).alias("x")).select((F.col("x.a") + F.col("half").cast("bigint") * (1 << 32)).alias("anchor"), "fp", F.col("x.home").alias("home"))


def forest(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by anchor, as a spanning forest of each anchor: (u, v)."""
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cuts, len(group)))
    homes = np.flatnonzero(home)
    owner = np.searchsorted(cuts, homes, side="right") - 1
    homes, owner = homes[size[owner] > 1], owner[size[owner] > 1]
    label = np.arange(len(fp))
    at = 0
    while at < len(homes):
        end = at + max(1, int(np.searchsorted(np.cumsum(size[owner[at:]]), BLOCK, side="right")))
        own = owner[at:end]
        left = np.repeat(homes[at:end], size[own])
        right = np.repeat(cuts[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(len(left))
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= THRESHOLD) & (left != right)
        left, right = left[near], right[near]
        while len(left):  # union by the smallest label, with pointer jumping
            a, b = label[left], label[right]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            open_ = label[left] != label[right]
            left, right = left[open_], right[open_]
        at = end
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def links(fps: DataFrame) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``fps(fp)`` that span all links there are."""

    def compare(batches):
        rest = None
        for batch in batches:
            g, f, h = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("anchor", "fp", "home"))
            if rest is not None:
                g, f, h = (np.concatenate(x) for x in zip(rest, (g, f, h)))
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last anchor may go on in the next batch
            rest = (g[whole:], f[whole:], h[whole:])
            if whole:
                u, v = forest(g[:whole], f[:whole].view(np.uint64), h[:whole])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if rest is not None and len(rest[0]):
            u, v = forest(rest[0], rest[1].view(np.uint64), rest[2])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    placed = anchors(fps)
    placed = placed.repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(compare, "u bigint, v bigint")


def classes(rows: DataFrame) -> DataFrame:
    """``(fp, root)`` for every fingerprint that has a link, from ``rows`` with a column ``fp``."""
    with long_batches(rows.sparkSession):
        found = components(links(rows.select("fp").distinct()))
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``."""
    marked = cut(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(classes(marked), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.select("fp", "root").join(first, "root").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
