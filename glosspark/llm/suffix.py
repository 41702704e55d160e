"""Suffix-array dedup: remove every byte covered by a ``LENGTH``-byte string that also starts elsewhere.

1. Owners. Each ``LENGTH``-byte window belongs to its anchor: the leftmost window minimiser over the hashes of its
   ``GRAM``-byte strings. Equal windows have equal anchors at equal distances, so equal windows always meet at one
   anchor hash. Consecutive windows of one anchor make a context of at most 2 * LENGTH - GRAM bytes.
2. Contexts that occur twice are repeated as a whole: one grouped count settles them, however many copies there are.
   Contexts whose anchor occurs once hold no repeat. What is left are the edges of copies: contexts that occur once
   beside other contexts of the same anchor.
3. Shards. The distinct contexts of such anchors go to shards of whole anchors. A shard is parsed into phrases at
   content-defined triggers (prefix-free parsing, Boucher et al. 2019); its phrases are numbered in lexicographic
   order, and ``sais`` builds the shard's suffix array by induced sorting and the permuted common prefixes, which
   are turned into bytes. Windows with the same bytes before their first trigger are ordered by the rank of the suffix
   behind it; a window is repeated if it shares LENGTH bytes with a neighbour in that order.
4. An anchor with more than ``HOT`` distinct contexts never lands in one shard: its windows are dealt out again, by the
   bytes that all windows near one distance to the anchor share (``context_pieces``), and settled by counts.

Equality of strings is decided on 64-bit digests beside the 64-bit anchor hash; the text itself only travels to
cut contexts and to remove spans.

Defined results: null and empty texts have no bytes and no spans; texts under LENGTH bytes are kept whole; repeated rows
count as copies of each other; ids may repeat or be null (rows are told apart by their text); an empty table gives
an empty table; extra columns pass through ``dedup`` (an input column with an output's name is replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import buffers, set_batches, text_udf
from glosspark.session import cut
from glosspark.llm.hashing import U, mix, prefix_hash, range_hash
from glosspark.llm.rows import packed, unpacked
from glosspark.llm.sais import permuted_lcp, suffix_array

LENGTH = 400
GRAM = 64  # gram_of(LENGTH)
TRIGGER = 8  # bytes that decide where a phrase starts
PHRASE = 32  # mean bytes between phrase starts
SHARD_BYTES = 3 << 20
PIECE = 16  # distances to the anchor that are dealt out as one where an anchor is hot
HOT = 1_000  # contexts of one anchor in a shard: some 0.7 MB
LIST = 5_000  # entries of a context's longest list of places, about


def gram_of(length: int) -> int:
    """Bytes of the strings whose hashes compete to be a window's anchor."""
    return 4 * length // 25


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time."""
    n = len(v)
    padded = np.concatenate([v, np.full(-n % width, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def contexts_of(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Every anchor's run of windows: row, first window start in the row, number of windows, anchor hash, context digest."""
    size = np.diff(offsets)
    starts = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), starts)
    if not len(row):
        return dict.fromkeys(("row", "start", "windows", "anchor", "digest", "ahead"), row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[:-1][row]
    prefix = prefix_hash(data)
    first = np.arange(len(data) - gram + 1)
    h = mix(range_hash(prefix, first, first + gram))
    ranked = (h & U(0xFFFFFFFF00000000)) | first.astype(np.uint64)
    anchor = (window_minima(ranked, length - gram + 1)[at] & U(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    windows = np.diff(np.append(cuts, len(anchor)))
    begin, a = at[cuts], anchor[cuts]
    digest = mix(range_hash(prefix, begin, begin + windows + length - 1) * U(0xD6E8FEB86659FD93) + (a - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15) + windows.astype(np.uint64))
    return {"row": row[cuts], "start": begin - offsets[:-1][row[cuts]], "windows": windows, "anchor": h[a].view(np.int64), "digest": digest.view(np.int64), "ahead": a - begin}


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


PLACES = "anchor array<bigint>, digest array<bigint>, start array<int>, windows array<int>, times array<int>"


def context_lists(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> dict:
    """Each row's contexts; equal ones that follow each other (text of a short period) are one entry with their number."""
    c, n = contexts_of(offsets, data, length, gram_of(length)), len(offsets) - 1
    at = np.flatnonzero(np.concatenate([[True], np.any([c[k][1:] != c[k][:-1] for k in ("row", "anchor", "digest")], axis=0)])[: len(c["row"])])
    c = {k: v[at] for k, v in c.items()} | {"times": np.diff(np.append(at, len(c["row"])))}
    kinds = (("anchor", np.int64), ("digest", np.int64), ("start", np.int32), ("windows", np.int32), ("times", np.int32))
    return {k: _lists(c[k].astype(t), c["row"], n) for k, t in kinds}


def common_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at ``a`` and ``b``, at most ``most`` each."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        live = live[data[a[live] + step] == data[b[live] + step]]
        step += 1
        out[live] = step
        live = live[most[live] > step]
    return out


def minimum_of_ranges(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(v[low..high]) for each pair, by a sparse table."""
    if not len(low):
        return np.zeros(0, v.dtype)
    levels = [v]
    width = int((high - low + 1).max())
    while 2 ** len(levels) <= width:
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    level = np.log2(high - low + 1).astype(np.int64)
    out = np.empty(len(low), v.dtype)
    for k, row in enumerate(levels):
        own = level == k
        out[own] = np.minimum(row[low[own]], row[high[own] - 2**k + 1])
    return out


def window_classes(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every ``length``-byte window of the distinct contexts, in order, the number of its class of equal windows."""
    size = np.diff(offsets)
    n = len(size)
    starts = np.maximum(size - length + 1, 0)
    ctx = np.repeat(np.arange(n), starts)
    if not len(ctx):
        return ctx
    at = np.arange(len(ctx)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[:-1][ctx]
    prefix = prefix_hash(data)
    first = np.arange(max(len(data) - TRIGGER + 1, 0))
    trigger = mix(range_hash(prefix, first, first + TRIGGER)) % U(PHRASE) == 0
    owner = np.searchsorted(offsets, first, side="right") - 1
    mark = first[trigger & (first + TRIGGER <= offsets[1:][owner])]
    owner = owner[mark]
    # phrases: from trigger to the end of the next trigger, or to the end of the context
    last = np.append(owner[1:] != owner[:-1], True) if len(mark) else np.zeros(0, bool)
    end = np.where(last, offsets[1:][owner], np.append(mark[1:], 0) + TRIGGER) if len(mark) else mark
    if len(mark):
        key = mix(range_hash(prefix, mark, end) + (end - mark).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        _, sample, name = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()
        phrases = [raw[a:b] for a, b in zip(mark[sample].tolist(), end[sample].tolist())]
        rank = np.empty(len(phrases), np.int64)
        rank[sorted(range(len(phrases)), key=phrases.__getitem__)] = np.arange(len(phrases))
        # the parse: phrase numbers, a sentinel of its own behind each context, 0 at the very end
        place = np.arange(len(mark)) + np.concatenate([[0], np.cumsum(last)[:-1]])
        parse = np.zeros(len(mark) + int(last.sum()) + 1, np.int64)
        parse[place] = rank[name] + 1 + n
        parse[place[last] + 1] = owner[last] + 1
        sa = suffix_array(parse, len(phrases) + n + 1)
        plcp = permuted_lcp(parse, sa)
        # symbols to bytes: whole phrases, then the common bytes of the first two that differ
        byte = np.zeros(len(parse), np.int64)
        byte[place] = mark
        byte[place[last] + 1] = offsets[1:][owner[last]]
        stop = byte.copy()
        stop[place] = end
        before = np.full(len(parse), -1)
        before[sa[1:]] = sa[:-1]
        common = np.zeros(len(parse), np.int64)
        ok = place[before[place] >= 0]
        i, j = ok + plcp[ok], before[ok] + plcp[ok]
        common[ok] = byte[i] - byte[ok] + common_bytes(data, byte[i], byte[j], np.minimum(stop[i] - byte[i], stop[j] - byte[j]))
        order = np.empty(len(parse), np.int64)
        order[sa] = np.arange(len(sa))
        lcp = common[sa]
        following = np.searchsorted(mark, at)
        inside = following < len(mark)
        to = np.where(inside, mark[np.minimum(following, len(mark) - 1)], len(data))
        inside &= to + TRIGGER <= at + length
        behind = np.where(inside, order[place[np.minimum(following, len(mark) - 1)]], -1)
    else:
        inside, behind, lcp = np.zeros(len(at), bool), np.full(len(at), -1), np.zeros(1, np.int64)
        to = at
    head = np.where(inside, to - at, length)
    key = mix(range_hash(prefix, at, at + head) + head.astype(np.uint64) * U(0x165667B19E3779F9))
    by = np.lexsort((behind, key))
    a, b = by[:-1], by[1:]
    equal = key[a] == key[b]
    far = np.flatnonzero(equal & (behind[a] >= 0))
    equal[far] = head[a[far]] + minimum_of_ranges(lcp, behind[a[far]] + 1, behind[b[far]]) >= length
    out = np.empty(len(at), np.int64)
    out[by] = np.concatenate([[0], np.cumsum(~equal)])
    return out


def repeated_windows(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of the distinct contexts, in order, whether it starts at another place too."""
    kind = window_classes(offsets, data, length)
    return np.bincount(kind)[kind] > 1


def later_windows(offsets: np.ndarray, data: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window whether an equal one starts in a context of smaller ``rank``."""
    kind = window_classes(offsets, data, length)
    rank = np.repeat(rank, np.maximum(np.diff(offsets) - length + 1, 0))
    first = np.full(len(rank), np.iinfo(np.int64).max)
    np.minimum.at(first, kind, rank)
    return rank > first[kind]


def _spans(repeated: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows of each context: context, first and last window start."""
    ctx = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(ctx)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return hit, hit, hit
    cuts = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (ctx[hit[1:]] != ctx[hit[:-1]])]))
    ends = np.append(cuts[1:], len(hit)) - 1
    return ctx[hit[cuts]], at[hit[cuts]], at[hit[ends]]


SPAN = pa.schema([("key", pa.binary()), ("s", pa.int32()), ("e", pa.int32())])


def shard_spans(batches, length: int = LENGTH, first: bool = False):
    """Contexts sorted by anchor -> spans ``(key, s, e)``; a shard is some whole anchors.

    Spans are those of repeated windows in contexts that occur once, or with ``first`` those of windows that
    have an equal one at a smaller place.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(table: pa.Table):
        texts = table.column("ctx").combine_chunks()
        offsets, data = buffers(texts)
        offsets, data = offsets - offsets[0], data[offsets[0] : offsets[-1]]
        windows = np.maximum(np.diff(offsets) - length + 1, 0)
        if first:
            by = pc.sort_indices(table.select(["key", "start"]), [("key", "ascending"), ("start", "ascending")])
            rank = np.empty(len(table), np.int64)
            rank[np.asarray(by)] = np.arange(len(table))
            found = later_windows(offsets, data, rank, length)
        else:
            found = repeated_windows(offsets, data, length)
        ctx, low, high = _spans(found, windows)
        if not first:
            once = np.asarray(table.column("once"))[ctx]
            ctx, low, high = ctx[once], low[once], high[once]
        start = np.asarray(table.column("start"))[ctx]
        return pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(ctx)), pa.array((start + low).astype(np.int32)), pa.array((start + high + length).astype(np.int32))], schema=SPAN)

    for batch in batches:
        held.append(batch)
        size += batch.column("ctx").nbytes
        if size >= SHARD_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = np.asarray(table.column("anchor"))
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:
                yield settle(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(x.column("ctx").nbytes for x in held)
    if held:
        table = pa.Table.from_batches(held)
        if len(table):
            yield settle(table)


def _cut_contexts(texts: pa.Array, asked: pa.Array, length: int) -> pa.Array:
    """The asked contexts (start, windows) of each text, as a list of binaries."""
    offsets, data = buffers(texts)
    raw = memoryview(data)
    out = []
    for at, row in zip(offsets[:-1].tolist(), asked.to_pylist()):
        out.append([bytes(raw[at + r["start"] : at + r["start"] + r["windows"] + length - 1]) for r in row])
    return pa.array(out, pa.list_(pa.binary()))


def context_pieces(offsets: np.ndarray, data: np.ndarray, length: int) -> pa.Array:
    """Each context's windows by their distance to the anchor, ``PIECE`` distances at a time.

    All windows of a piece, wherever they start, share its core: ``length - PIECE + 1`` bytes at fixed distances from the
    anchor. Equal windows therefore lie in pieces of equal cores.
    """
    c = contexts_of(offsets, data, length, gram_of(length))
    prefix = prefix_hash(data)
    begin, ahead, windows = offsets[:-1][c["row"]] + c["start"], c["ahead"], c["windows"]
    low, high = (ahead - windows + 1) // PIECE, ahead // PIECE
    number = high - low + 1
    ctx = np.repeat(np.arange(len(number)), number)
    j = np.arange(len(ctx)) - np.repeat(np.cumsum(number) - number, number) + low[ctx]
    p = np.maximum(0, ahead[ctx] - (j * PIECE + PIECE - 1))
    m = np.minimum(windows[ctx] - 1, ahead[ctx] - j * PIECE) - p + 1
    anchor = begin[ctx] + ahead[ctx]
    core = mix(range_hash(prefix, anchor - j * PIECE, anchor - (j * PIECE + PIECE - 1) + length) + j.astype(np.uint64) * U(0x9E3779B97F4A7C15) + c["anchor"][ctx].view(np.uint64))
    at = begin[ctx] + p
    content = mix(range_hash(prefix, at, at + m + length - 1) * U(0xD6E8FEB86659FD93) + (ahead[ctx] - p).astype(np.uint64) * U(0x9E3779B97F4A7C15) + m.astype(np.uint64))
    own = np.repeat(np.arange(len(m)), m)
    each = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m) + at[own]
    digests = _lists(mix(range_hash(prefix, each, each + length)).view(np.int64), own, len(m))
    kind = [("core", pa.int64()), ("content", pa.int64()), ("p", pa.int32()), ("m", pa.int32()), ("w", pa.list_(pa.int64()))]
    values = [pa.array(core.view(np.int64)), pa.array(content.view(np.int64)), pa.array((c["start"][ctx] + p).astype(np.int32)), pa.array(m.astype(np.int32)), digests]
    rows = pa.StructArray.from_arrays(values, fields=[pa.field(*k) for k in kind])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(c["row"][ctx], np.arange(len(offsets))), pa.int32()), rows)


def _removal(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Bytes, removed bytes, maximal removed runs, digest of the rest, and the runs and the rest themselves."""
    offsets, data = buffers(texts)
    raw = memoryview(data)
    rows = []
    for a, b, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans.to_pylist()):
        runs: list[list[int]] = []
        for s, e in sorted((x["s"], x["e"]) for x in found or ()):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        rest, at = hashlib.sha256(), 0
        for s, e in runs:
            rest.update(raw[a + at : a + s])
            at = e
        rest.update(raw[a + at : b])
        rows.append({"n_bytes": b - a, "n_removed": sum(e - s for s, e in runs), "n_spans": len(runs), "kept_sha256": rest.hexdigest(), "removed": [{"s": s, "e": e} for s, e in runs]})
    return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]))


def _kept_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left of each text; bytes of a character that a span cuts are dropped with it."""
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        if not found:
            out.append(text)
            continue
        raw, keep, at = (text or "").encode(), [], 0
        for s, e in sorted((x["s"], x["e"]) for x in found):
            if s > at:
                keep.append(raw[at:s])
            at = max(at, e)
        out.append((b"".join(keep) + raw[at:]).decode("utf-8", "ignore"))
    return pa.array(out, pa.string())


def _two(function, ddl):
    function.__annotations__ = {"texts": pa.Array, "asked": pa.Array, "spans": pa.Array, "return": pa.Array}
    from pyspark.sql.types import _parse_datatype_string

    return F.arrow_udf(function, _parse_datatype_string(ddl)).asNondeterministic()


def repeated_spans(docs: DataFrame, text: str = "text", hot: int = HOT, length: int = LENGTH, first: bool = False) -> DataFrame:
    """``(key, spans)``: for each text (by its MD5) the spans, maybe overlapping, that repeated windows cover.

    With ``first`` the occurrence at the smallest (key, offset) of each window is no repeat and keeps its bytes.
    """
    set_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    lists = text_udf(lambda o, d: context_lists(o, d, length), PLACES, 1 << 20)
    found = texts.select("key", lists("text").alias("c"))
    # read twice below: finding the anchors again costs less than keeping a row for each of them
    found = found.select("key", F.explode(F.arrays_zip("c.anchor", "c.digest", "c.start", "c.windows", "c.times")).alias("x")).select("key", "x.*")
    twice = found.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    # occurrences are gathered in salted lists, dealt by context and salt: one in a third of all texts gives LIST entries a row,
    # and a join that is followed by a deal of its own is one that the engine may split where an anchor is hot
    salts = max(64, docs.count() // LIST)
    near = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    met = found.join(twice, "anchor", "left_semi").withColumn("salt", near).repartition("anchor", "digest", "salt")
    known = cut(met.groupBy("anchor", "digest", "salt").agg(F.sum("times").alias("n"), F.collect_set(F.struct("key", "start", "windows", "times")).alias("places")))
    distinct = cut(known.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.array_min("places")).alias("at")))
    # a list of two is a repeat by itself; only lists of one are looked up
    alone = known.filter("n = 1").select("anchor", "digest", "places").join(distinct.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    place = [F.col("p.key").alias("key"), F.col("p.start").alias("s"), (F.col("p.start") + F.col("p.windows") * F.col("p.times") + (length - 1)).alias("e")]
    whole = known.filter("n > 1").select(F.explode("places").alias("p")).unionByName(alone.select(F.col("places")[0].alias("p"))).select(*place, F.lit(0).alias("kind"))
    if first:  # the smallest place is no repeat, but what follows it in a row is
        least = distinct.filter("n > 1").select(F.col("at").alias("p"))
        whole = whole.unionByName(least.select(*place, F.lit(1).alias("kind")))
        whole = whole.unionByName(least.filter("p.times > 1").select(place[0], (F.col("p.start") + F.col("p.windows")).alias("s"), place[2], F.lit(2).alias("kind")))
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("open")).filter("kinds > 1" if first else "kinds > 1 AND open = 1").select("anchor", "kinds")
    asked = distinct.join(mixed, "anchor").select("anchor", F.col("at.key").alias("key"), F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), (F.col("n") == 1).alias("once"), (F.col("kinds") > hot).alias("hot"))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "windows", "once", "hot")).alias("asked"))
    one = texts.withColumn("rn", F.expr("row_number() OVER (PARTITION BY key ORDER BY key)")).filter("rn = 1").select("key", "text")
    cut_out = _two(lambda texts, asked: _cut_contexts(texts, asked, length), "array<binary>")
    got = one.join(asked, "key").select("key", "asked", cut_out("text", "asked").alias("ctx"))
    got = got.select("key", F.explode(F.arrays_zip("asked", "ctx")).alias("x")).select("key", "x.asked.*", "x.ctx")
    got = cut(got)
    shards = got.filter("NOT hot").select("anchor", "key", "start", "once", "ctx").repartition("anchor").sortWithinPartitions("anchor")
    edges = shards.mapInArrow(lambda batches: shard_spans(batches, length, first), "key binary, s int, e int")
    if not got.filter("hot").isEmpty():
        edges = edges.unionByName(hot_spans(got.filter("hot"), length, first))
    rows = whole.unionByName(edges.withColumn("kind", F.lit(2)))
    # as one number each, which the set functions can hash
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.shiftleft(F.col("s").cast("bigint"), 32) + F.col("e"))).alias(f"k{k}")
    sets = rows.groupBy("key").agg(*(of(k) for k in range(3)))
    span = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("s"), x.bitwiseAND(0xFFFFFFFF).cast("int").alias("e"))
    return sets.select("key", F.transform(F.array_union(F.array_except("k0", "k1"), "k2"), span).alias("spans"))


def hot_spans(contexts: DataFrame, length: int, first: bool) -> DataFrame:
    """Spans ``(key, s, e)`` of ``contexts(key, start, once, ctx)`` that share their anchor with too many others for one shard.

    Pieces of equal bytes are settled by count; of those that only share a core, the windows are.
    """
    find = text_udf(lambda o, d: context_pieces(o, d, length), "array<struct<core bigint, content bigint, p int, m int, w array<bigint>>>", 1 << 20)
    pieces = contexts.select("key", "start", "once", F.explode(find("ctx")).alias("x")).select("key", (F.col("start") + F.col("x.p")).alias("s"), "once", F.col("x.m").alias("m"), "x.w", "x.core", "x.content")
    groups = pieces.groupBy("core", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "s", "once", "m", "w")).alias("rep"))
    copies = pieces.join(groups.filter("n > 1").select("core", "content", F.struct("rep.key", "rep.s").alias("least")), ["core", "content"])
    copies = copies.filter(F.struct("key", "s") != F.col("least") if first else F.col("once")).select("key", "s", (F.col("s") + F.col("m") + (length - 1)).alias("e"))
    shared = groups.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core")
    windows = groups.join(shared, "core", "left_semi").select("core", "rep.key", "rep.s", "rep.once", F.posexplode("rep.w").alias("p", "w"))
    windows = windows.select("core", "w", "key", (F.col("s") + F.col("p")).alias("s"), "once")
    again = windows.groupBy("core", "w").agg(F.count("*").alias("n"), F.min(F.struct("key", "s")).alias("least")).filter("n > 1").select("core", "w", "least")
    busy = windows.join(again, ["core", "w"]).filter(F.struct("key", "s") != F.col("least") if first else F.col("once"))
    return copies.unionByName(busy.select("key", "s", (F.col("s") + length).alias("e")))


def _joined(docs: DataFrame, text: str, **how) -> DataFrame:
    """``(row, text, spans)``: the other columns packed, so that no name of theirs can clash."""
    spans = repeated_spans(docs, text, **how).select(F.col("key").alias("_k"), "spans")
    keyed = packed(docs, text).withColumn("key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return keyed.join(spans, F.col("key") == F.col("_k"), "left").select("row", "text", "spans")


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and the removed byte runs ``removed``."""
    remove = _two(lambda texts, spans: _removal(texts, spans), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<s int, e int>>")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    out = _joined(docs, text, length=length).withColumn("found", remove(F.col("text"), F.col("spans")))
    return out.select(*unpacked(docs, text, without=names), *(F.col(f"found.{c}") for c in names))


def strip(docs: DataFrame, text: str = "text", length: int = LENGTH, first: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; other columns as they were.

    With ``first`` one occurrence of each repeated string stays, that in the text of the smallest MD5, whatever the order
    of the rows. Equal texts have one MD5, so copies of whole rows are left to near-duplicate removal.
    """
    keep = _two(lambda texts, spans: _kept_text(texts, spans), "string")
    return _joined(docs, text, length=length, first=first).withColumn("text", keep(F.col("text"), F.col("spans"))).select(*unpacked(docs, text))
