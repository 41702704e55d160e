"""Words, morphs and references of normal lines, with offsets down to the line."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.session import cut, wide

TIER_OF = {"L": "w", "G": "gw", "T": "tw"}


def _placed(rows: DataFrame, keys: list[str], text: str, pattern, keep: list[str]) -> DataFrame:
    """Explode ``text`` into tokens with offsets: running sums of token and gap lengths, linear in the text."""
    parts = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("tok"), F.split(text, pattern, F.lit(-1)).alias("gap"))
    rows = rows.select(*keys, *keep, F.posexplode(parts).alias("i", "t")).filter("t.tok IS NOT NULL")
    rows = rows.select(*keys, *keep, (F.col("i") + 1).alias("idx"), F.col("t.tok").alias("tok"), F.col("t.gap").alias("gap"))
    stop = F.expr(f"cast(sum(length(gap) + length(tok)) OVER (PARTITION BY {', '.join(keys)} ORDER BY idx) AS int)")
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("tok")).drop("gap")


def words(normal: DataFrame) -> DataFrame:
    """(igt_id, tier, idx, tok, start, stop): language and gloss lines at white space, translations as sentences."""
    tier = F.create_map(*(F.lit(x) for kv in TIER_OF.items() for x in kv))[F.col("tag")]
    rows = normal.select("igt_id", tier.alias("tier"), "text", F.when(F.col("tag") == "T", T.SENTENCE).otherwise(T.NOT_WS).alias("_p"))
    parts = [_placed(rows.filter(F.col("_p") == p), ["igt_id", "tier"], "text", F.lit(p), []) for p in (T.SENTENCE, T.NOT_WS)]
    return parts[0].unionByName(parts[1]).select("igt_id", "tier", "idx", "tok", "start", "stop")


def morphs(word_table: DataFrame) -> DataFrame:
    """Sub-words of language and gloss words, numbered through the instance, with the word they come from and offsets in the line."""
    rows = word_table.filter("tier IN ('w', 'gw')").select("igt_id", "tier", F.col("idx").alias("word_idx"), F.col("start").alias("_s"), F.col("tok").alias("_w"), F.size(T.morphs("tok")).alias("_n"))
    m = _placed(rows, ["igt_id", "tier", "word_idx"], "_w", F.lit(T.MORPH), ["_s", "_n"])
    idx = F.expr("row_number() OVER (PARTITION BY igt_id, tier ORDER BY word_idx, idx)")
    m = m.select("igt_id", F.when(F.col("tier") == "w", "m").otherwise("g").alias("tier"), idx.alias("_idx"), "word_idx", "tok", (F.col("_s") + F.col("start")).alias("_a"), (F.col("_s") + F.col("stop")).alias("_b"), (F.col("_n") == 1).alias("whole"), F.col("start").alias("in_word_start"), F.col("stop").alias("in_word_stop"))
    return m.withColumnsRenamed({"_idx": "idx", "_a": "start", "_b": "stop"})


def morph_references(morph_table: DataFrame, prefix: str) -> DataFrame:
    """Each morph's pointer: the bare word id if it is the whole word, else ``id[s:e]``."""
    word = F.concat(F.lit(prefix), F.col("word_idx").cast("string"))
    return morph_table.withColumn("ref", F.when(F.col("whole"), word).otherwise(T.reference(word, F.col("in_word_start"), F.col("in_word_stop"))))


def gaps(morph_table: DataFrame, normal: DataFrame, tag: str) -> DataFrame:
    """Morphs with ``gap``, the characters between each and the next on the line."""
    lines = normal.filter(F.col("tag") == tag).select("igt_id", F.col("text").alias("_line"))
    nxt = F.expr("lead(start) OVER (PARTITION BY igt_id, tier ORDER BY idx)")
    return morph_table.withColumn("_next", nxt).join(wide(lines), "igt_id").withColumn("gap", F.expr("CASE WHEN _next IS NOT NULL THEN substring(_line, stop + 1, _next - stop) END")).drop("_line", "_next")


def containing(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Each inner span's first outer span that contains it: (key.., idx, outer_idx)."""
    o = outer.select(*keys, F.col("idx").alias("outer_idx"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    j = inner.join(wide(o), keys).filter("start >= _a AND stop <= _b")
    return j.groupBy(*keys, "idx").agg(F.min("outer_idx").alias("outer_idx"))


def resolve(references: DataFrame, items: DataFrame) -> DataFrame:
    """``references(igt_id, ref_from, expr)`` against ``items(igt_id, item_id, value)``: the text each part points to; unknown ids give a null value."""
    parts = references.select("igt_id", "ref_from", F.posexplode(T.parse_reference("expr")).alias("part", "r")).select("igt_id", "ref_from", "part", F.col("r.id").alias("item_id"), F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    j = parts.join(items.select("igt_id", "item_id", "value"), ["igt_id", "item_id"], "left")
    return j.withColumn("value", F.when(F.col("s").isNull(), F.col("value")).otherwise(F.expr("substring(value, s + 1, e - s)")))


def line_of(items: DataFrame) -> DataFrame:
    """(igt_id, item_id, line_id): follow ``parent`` up to an item without one, however long the chain; a circle raises."""
    up = items.filter("parent IS NOT NULL").select("igt_id", F.col("item_id").alias("_i"), F.col("parent").alias("_p"))
    now = items.select("igt_id", "item_id", F.coalesce("parent", "item_id").alias("line_id"))
    most = None
    for step in itertools.count(1):
        now = cut(now.join(up, (now.igt_id == up.igt_id) & (now.line_id == up._i), "left").select(now.igt_id, "item_id", F.coalesce("_p", "line_id").alias("line_id"), F.col("_p").isNotNull().alias("open")))
        if now.filter("open").isEmpty():
            return now.drop("open")
        most = items.groupBy("igt_id").count().agg(F.max("count")).first()[0] if most is None else most
        if step > most:
            raise ValueError("items refer to each other in a circle")


def phrases(normal: DataFrame) -> DataFrame:
    """(igt_id, tier, item_id, text, judgment, aligned): one phrase per language and translation line, the translation's aligned to the language's."""
    own = normal.filter("tag IN ('L', 'T')").withColumn("tier", F.when(F.col("tag") == "L", "p").otherwise("t"))
    other = own.filter("tier = 'p'").select("igt_id", F.lit("p1").alias("_p"))
    rows = own.join(other, "igt_id", "left")
    return rows.select("igt_id", "tier", F.concat("tier", F.lit("1")).alias("item_id"), "text", "judgment", F.when(F.col("tier") == "t", F.col("_p")).alias("aligned"))
