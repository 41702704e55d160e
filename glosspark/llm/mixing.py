"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) take weights from a repeating list and share a budget of words; no target exceeds
``cap`` times its source's size, and what a cap leaves over is shared again by weight (water filling, solved in closed form
over the sources sorted by cap over weight). A document of a source with target over size e is taken floor(e) times for
certain. The rest of the target is a fixed-size sample: with inclusion odds p / (1 - p), p = e - floor(e), and a random
number u hashed from the row itself, documents are ranked by (u / (1 - u)) / (p / (1 - p)) (Rosen 1997) and taken in that
order until one does not fit. What is then missing is less than that document: among the next LOOK_AHEAD in rank those that
fit fill it up, and the one whose size comes nearest to the rest closes it.

Size is fixed in words, so no source needs an order over all its rows in one task: ranks are bucketed, bucket sums find
the bucket where the sample ends, and only that bucket is sorted. The decision is then a comparison of each row with its
source's few numbers, so texts are never shuffled.

Defined results: null and empty texts have size 0 and are taken like any other, with 0 words; a null source is a source of its
own; rows equal in doc_id and text are taken alike; an empty source has target 0; an empty table gives an empty
table; extra columns pass through (an input column with an output's name is replaced). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.rows import field, packed, unpacked
from glosspark.session import cut

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
LOOK_AHEAD = 128
SMALL = 5000  # sources; their rows hold some hundred bytes and at most LOOK_AHEAD + 1 keys each
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"
KEYS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank_key(seed: int) -> Column:
    """32 hex digits from the row alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``; one row per source."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)") - 1) % len(weights) + 1)
    w = sizes.withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    w = w.withColumn("before", F.expr("coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"))
    w = w.withColumn("open", F.expr("sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
    w = w.withColumn("level", (F.lit(share) * F.expr("sum(source_size) OVER ()") - F.col("before")) / F.col("open"))
    w = w.withColumn("level", F.expr("min(CASE WHEN most / w >= level THEN struct(most / w AS at, level) END) OVER ()")["level"])
    return w.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Add u, the Pareto rank q, and its bucket to rows with key and p."""
    u = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = rows.withColumn("u", u).withColumn("q", F.try_divide(F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p"))))
    return out.withColumn("bucket", F.floor(F.lit(float(BUCKETS)) * (F.col("q") / (1 + F.col("q")))))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join rows with the few numbers of their source: broadcast up to ``SMALL`` sources, else salted, so that a hot source is dealt out."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sources.count() <= SMALL:
        return rows.join(F.broadcast(sources), same)
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_s") == F.col("_salt"))).drop("_s", "_salt")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source with all that decides its documents, from ``rows(source, size, key)``."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = sources.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = cut(sources.withColumnRenamed("source", "_source"))
    ranked = _ranked(_with_source(rows, sources.filter("p > 0").select("_source", "p", "rest"))).drop("source")
    sums = ranked.groupBy("_source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.expr("sum(n) OVER (PARTITION BY _source ORDER BY bucket)"))
    edge = sums.filter("upto > rest").groupBy("_source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("edge")).select(F.col("_source").alias("_s"), F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    edge = cut(edge)
    whole_rank = F.struct("q", "key")
    tail = ranked.join(edge, F.col("_source").eqNullSafe(F.col("_s"))).filter("bucket >= edge").groupBy("_source", "bucket", "edge", "before", "rest", "q", "key").agg(F.sum("size").alias("n"))
    tail = cut(tail)
    fits = tail.filter("bucket = edge").withColumn("upto", F.expr("before + sum(n) OVER (PARTITION BY _source ORDER BY q, key)")).filter("upto <= rest")
    ends = fits.groupBy("_source").agg(F.max(whole_rank).alias("last"), F.max("upto").alias("upto")).select(F.col("_source").alias("_t"), "last", "upto")
    gap = tail.join(ends, F.col("_source").eqNullSafe(F.col("_t")), "left").filter(F.col("last").isNull() | (whole_rank > F.col("last"))).withColumn("missing", F.col("rest") - F.coalesce("upto", "before"))
    gap = cut(gap.withColumn("rn", F.expr("row_number() OVER (PARTITION BY _source ORDER BY q, key)")).filter(F.col("rn") <= LOOK_AHEAD).select("_source", "q", "key", "n", "missing", "last"))
    small = gap.filter("n <= missing").withColumn("upto", F.expr("sum(n) OVER (PARTITION BY _source ORDER BY q, key)")).filter("upto <= missing")
    small = small.groupBy("_source").agg(F.collect_list("key").alias("fill"), F.max("upto").alias("filled")).select(F.col("_source").alias("_f"), "fill", "filled")
    left = gap.join(small, F.col("_source").eqNullSafe(F.col("_f")), "left").filter("fill IS NULL OR NOT array_contains(fill, key)").withColumn("missing", F.col("missing") - F.coalesce("filled", F.lit(0)))
    close = left.filter("abs(missing - n) < missing").groupBy("_source").agg(F.min(F.struct(F.abs(F.col("missing") - F.col("n")).alias("d"), "key")).alias("c")).select(F.col("_source").alias("_c"), F.array("c.key").alias("close"))
    out = sources.join(edge, F.col("_source").eqNullSafe(F.col("_s")), "left").join(ends, F.col("_source").eqNullSafe(F.col("_t")), "left")
    out = out.join(small, F.col("_source").eqNullSafe(F.col("_f")), "left").join(close, F.col("_source").eqNullSafe(F.col("_c")), "left")
    none = F.array().cast("array<string>")
    return cut(out.select("_source", "source_size", "target", "whole", "p", "edge", "last", F.concat(F.coalesce("fill", none), F.coalesce("close", none)).alias("fill")))


def _mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 9) -> DataFrame:
    """``(row, text)`` of ``docs`` with KEYS."""
    named = packed(docs).select("row", "text", field(docs, "doc_id").alias("doc_id"), field(docs, "source").alias("source"))
    keyed = named.withColumn("size", word_count(F.col("text"))).withColumn("key", rank_key(seed))
    chosen = plan(cut(keyed.select("source", "size", "key")), weights, share, cap)
    out = _ranked(_with_source(keyed, chosen))
    more = (F.col("p") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.col("last").isNotNull() & (F.struct("q", "key") <= F.col("last"))) | F.array_contains("fill", F.col("key")))
    out = out.withColumn("copies", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")).cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("row", "text", *KEYS)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies * size)."""
    return _mixed(docs, **settings).select(*unpacked(docs, without=KEYS), *KEYS)


def repeat_copies(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, with the columns of ``docs``."""
    mixed = _mixed(docs, **settings).filter("copies > 0")
    return mixed.select("row", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).select(*unpacked(docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('9:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, most / w) FROM l WHERE most / w >= level) * w, most)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0.0 END AS p FROM t),
r AS (SELECT d.*, e.* EXCLUDE (source), target - whole * source_size AS rest, ('0x' || key[1:13])::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r),
k AS (SELECT source, key, q, any_value(rest) AS rest, sum(size)::BIGINT AS n FROM q WHERE p > 0 GROUP BY source, key, q),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY q, key) AS upto FROM k),
f AS (SELECT *, min(CASE WHEN upto > rest THEN (q, key) END) OVER (PARTITION BY source) AS stop FROM c),
a AS (SELECT source, key, q, n, stop IS NULL OR (q, key) < stop AS within, rest - coalesce(max(CASE WHEN stop IS NULL OR (q, key) < stop THEN upto END) OVER (PARTITION BY source), 0) AS missing FROM f),
g AS (SELECT * FROM a WHERE NOT within QUALIFY row_number() OVER (PARTITION BY source ORDER BY q, key) <= 128),
m AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY q, key) AS upto FROM g WHERE n <= missing QUALIFY sum(n) OVER (PARTITION BY source ORDER BY q, key) <= missing),
z AS (SELECT g.source, g.key, g.n, g.missing - coalesce((SELECT max(upto) FROM m WHERE m.source IS NOT DISTINCT FROM g.source), 0) AS missing FROM g WHERE key NOT IN (SELECT key FROM m)),
x AS (SELECT key FROM a WHERE within UNION SELECT key FROM m UNION SELECT arg_min(key, (abs(missing - n), key)) FROM z WHERE abs(missing - n) < missing GROUP BY source)
SELECT doc_id, size, source_size, target, (whole + (p > 0 AND key IN (SELECT key FROM x))::INT)::BIGINT * size AS taken FROM q
"""
