r"""Substring dedup by hashing lines, paragraphs, and pieces of text.

Words are ``[^\x20\x09-\x0D]+``, A-Z lower-cased; a unit is a run of words and is hashed as its words alone, so white space
does not count. ``line`` and ``paragraph`` units end at line ends or blank lines. ``piece`` units end behind every word whose MD5
starts below ``CUT`` (one in six) and nowhere else, so that a passage is cut alike wherever it stands and however it is wrapped. ``mixed``,
the default, takes pieces, and lines of ``LINE_WORDS`` = 4 words or more beside them. Digests are grouped over the whole corpus with map-side partial
counts. The occurrence of the smallest (doc_id, text hash, offset) stays, null ids last; the others are repeats. Pieces that follow
each other and are repeats make a run. A run of ``min_words`` words or more is removed, a line by itself; every removal keeps its
byte offsets in the original text, and those of a line and a run may overlap. What a removal takes stands at an earlier place too, so of
all copies of a word's surroundings the earliest is never removed.

A run ends where its last whole piece ends: of a passage that stands in foreign text some five words at either end stay.

Equality of units is decided on 64-bit digests, and rows of one doc_id are told apart by a 64-bit hash of their texts. The join that looks up the repeats is followed by a deal by document, so the
engine may split it where a unit is very common.

Defined results: null and empty texts have no units; rows equal in doc_id and text are one occurrence, kept or removed together, with
one row for each removal; an empty table gives an empty table; extra columns are ignored by ``repeated_units`` and kept by
``strip``, whatever their names.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.hashing import LOWER, WORDS, mix, prefix_hash, range_hash, tokens
from glosspark.llm.rows import field, packed, unpacked

MIN_WORDS, LINE_WORDS = 16, 4
CUT = "2b"  # 43 of 256
BREAKS = {"line": 1, "paragraph": 2}  # line ends that end a unit
UNITS = "array<struct<i int, digest bigint, start int, stop int, words int>>"
OF_LINES = np.uint64(0x9E3779B97F4A7C15)  # keeps the digests of lines apart from those of pieces


def units_slice(offsets: np.ndarray, data: np.ndarray, unit: str, least: int) -> pa.Array:
    """Each row's units: pieces numbered from 0, lines and paragraphs of ``least`` words or more from -1 down."""
    low = LOWER[data]
    start, end, row = tokens(offsets, low, WORDS)
    word = mix(range_hash(prefix_hash(low), start, end))
    turns = np.ones(len(start), bool)
    turns[1:] = row[1:] != row[:-1]
    of_words, columns = prefix_hash(word), []

    def add(opens: np.ndarray, pieces: bool) -> None:
        at = np.flatnonzero(opens)
        to = np.append(at[1:], len(start))[: len(at)]
        # the words' hashes, hashed as a sequence
        digest = mix((range_hash(of_words, at, to) + (to - at).astype(np.uint64)) ^ (np.uint64(0) if pieces else OF_LINES))
        place = np.arange(len(at)) - np.searchsorted(row[at], row[at])
        keep = slice(None) if pieces else to - at >= least
        columns.append([x[keep] for x in (row[at], place if pieces else -1 - place, digest, start[at], end[to - 1], to - at)])

    if unit in ("piece", "mixed"):
        opens = turns.copy()
        _, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        raw = low.tobytes()
        cuts = np.array([md5(raw[a:b]).hexdigest() < CUT for a, b in zip(start[first].tolist(), end[first].tolist())], bool)
        opens[1:] |= cuts[inverse][:-1]
        add(opens, True)
    if unit != "piece":
        ends = np.concatenate([[0], np.cumsum(data == 10)])
        opens = turns.copy()
        opens[1:] |= ends[start[1:]] - ends[end[:-1]] >= BREAKS.get(unit, 1)
        add(opens, False)
    rows, i, digest, a, b, words = (np.concatenate(x) for x in zip(*columns))
    order = np.argsort(rows, kind="stable")
    base = offsets[:-1][rows]
    kind = [("i", pa.int32()), ("digest", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())]
    values = [i.astype(np.int32), digest.view(np.int64), (a - base).astype(np.int32), (b - base).astype(np.int32), words.astype(np.int32)]
    found = pa.StructArray.from_arrays([pa.array(v[order], k) for v, (_, k) in zip(values, kind)], fields=[pa.field(*k) for k in kind])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(len(offsets))), pa.int32()), found)


def removals(rows: DataFrame, unit: str, min_words: int, line_words: int) -> DataFrame:
    """Removed runs, lines or paragraphs of ``rows(id, h, text)``: ``(id, h, unit, start, stop, n_words, n_units, first, copies)``."""
    set_batches(rows.sparkSession)
    least = line_words if unit == "mixed" else min_words
    find = text_udf(lambda o, d: units_slice(o, d, unit, least), UNITS, 1 << 20)
    units = rows.select("id", "h", F.explode(find("text")).alias("u")).select("id", "h", "u.*")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "h", "start")
    groups = units.groupBy("digest").agg(F.count("*").alias("copies"), F.min(place).alias("first")).filter("copies > 1")
    again = units.join(groups, "digest").filter(place != F.col("first")).select("id", "h", "i", "start", "stop", "words", "copies", "first")
    again = again.repartition("id", "h").dropDuplicates(["id", "h", "i"])  # one deal by row serves the repeats, the islands and the runs
    island = "CASE WHEN i < 0 THEN i ELSE i - dense_rank() OVER (PARTITION BY id, h, i < 0 ORDER BY i) END"
    again = again.withColumn("island", F.expr(island))
    runs = again.groupBy("id", "h", F.expr("i < 0").alias("whole"), "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.count("*").alias("n_units"), F.min(F.struct("i", "first")).alias("f"), F.min("copies").alias("copies"))
    name = F.when(F.col("whole"), "paragraph" if unit == "paragraph" else "line").otherwise("run")
    return runs.filter(F.col("whole") | (F.col("n_words") >= min_words)).select("id", "h", name.alias("unit"), "start", "stop", "n_words", "n_units", F.col("f.first").alias("first"), "copies")


def repeated_units(docs: DataFrame, text: str = "text", unit: str = "mixed", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """One row per removal: doc_id, run or line, start, stop (bytes), its words and units, the kept occurrence of its first unit, and the least count of its units."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return removals(rows, unit, min_words, line_words).select(F.col("id").alias("doc_id"), "unit", "start", "stop", "n_words", "n_units", F.col("first.id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "copies")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for x in sorted((x["start"], x["stop"]) for x in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(x[1], out[-1][1]))
        else:
            out.append(x)
    return out


def strip(docs: DataFrame, text: str = "text", unit: str = "mixed", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with the removals cut out of ``text``, a line that is removed whole with its end; other columns as they were."""
    keyed = packed(docs, text).withColumn("id", field(docs, "doc_id")).withColumn("h", F.xxhash64("text"))
    spans = removals(keyed, unit, min_words, line_words).groupBy("id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "spans")

    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, found in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            if found:
                at, keep = 0, []
                for x in merged(found):
                    keep.append(raw[at : x[0]])
                    at = x[1]
                    if raw[: x[0]].rpartition(b"\n")[2].strip() == b"" == raw[at:].partition(b"\n")[0].strip():
                        at += len(raw[at:].partition(b"\n")[0]) + 1
                raw = b"".join(keep) + raw[at:]
            out.append(raw)
        return pc.cast(pa.array(out, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))

    cut_out.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    joined = keyed.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return joined.withColumn("text", F.arrow_udf(cut_out, "string").asNondeterministic()(F.col("text"), F.col("spans"))).select(*unpacked(docs, text))


def oracle(*kinds: tuple[str, str, str, int, int]) -> str:
    """The removals in DuckDB SQL, without digests: of each kind its name, where a unit begins, its island, its least words, and those of a removal."""
    parts, rows = [], []
    for k, (name, cut, island, unit_words, least) in enumerate(kinds):
        parts.append(rf"""c{k} AS (SELECT *, sum(CASE WHEN prev IS NULL OR {cut} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS i FROM w),
u{k} AS (SELECT rid, doc_id, i, string_agg(word, ' ' ORDER BY k) AS norm, min(pos) AS start, max(pos + strlen(tok))::INT AS stop, count(*) AS words FROM c{k} GROUP BY rid, doc_id, i HAVING count(*) >= {unit_words}),
n{k} AS (SELECT *, count(*) OVER (PARTITION BY norm) AS copies, first_value(doc_id) OVER f AS first_doc_id, first_value(start) OVER f AS first_start FROM u{k} WINDOW f AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, start)),
r{k} AS (SELECT *, {island} AS island FROM n{k} WHERE copies > 1 AND (doc_id, start) IS DISTINCT FROM (first_doc_id, first_start))""")
        rows.append(f"SELECT doc_id, '{name}' AS unit, min(start) AS start, max(stop) AS stop, sum(words)::BIGINT AS n_words, count(*) AS n_units, arg_min(first_doc_id, i) AS first_doc_id, arg_min(first_start, i) AS first_start, min(copies) AS copies FROM r{k} GROUP BY rid, doc_id, island HAVING sum(words) >= {least}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT doc_id, text FROM documents)),
t AS (SELECT rid, doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')) AS tok, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), 1) AS k FROM d),
p AS (SELECT *, coalesce(sum(strlen(tok)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos,
             lag(tok) OVER (PARTITION BY rid ORDER BY k) AS sep, translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM t),
w AS (SELECT *, lag(word) OVER (PARTITION BY rid ORDER BY k) AS prev FROM p WHERE regexp_matches(tok, '^[^\x20\x09-\x0D]')),
{",".join(parts)}
{" UNION ALL ".join(rows)}
"""


_RUNS = ("run", f"md5(prev) < '{CUT}'", "i - row_number() OVER (PARTITION BY rid ORDER BY i)", 1, MIN_WORDS)
_LINE = "contains(sep, chr(10))"
ORACLE = oracle(_RUNS, ("line", _LINE, "i", LINE_WORDS, LINE_WORDS))

#: The same for every whole line that is not blank.
ORACLE_ALL = oracle(("line", _LINE, "i", 1, 1))
