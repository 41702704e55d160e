"""Alignment relations ``(key..., src, tgt)``: set algebra, symmetrization, heuristic alignment, composition.

An alignment is a distinct relation of 1-based index pairs per instance; 0 stands for the NULL word. Every operator takes
and returns DataFrames; ``keys`` names the columns of an instance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions.stem import stems
from glosspark.session import cut, ship, wide

# fixed values: glosses of closed-class words
GRAM_WORDS = {
    "1sg": ["i", "me"], "det": ["the"], "3pl": ["they"], "3sg": ["he", "she", "him", "her"], "3sgf": ["she", "her"],
    "2sg": ["you"], "3sgp": ["he"], "poss": ["his", "her", "my", "their"], "neg": ["n't", "not"], "2pl": ["you"],
}
NEIGHBOURS = [(-1, 0), (0, -1), (1, 0), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def pairs(aln: DataFrame, keys: list[str]) -> DataFrame:
    return aln.select(*keys, "src", "tgt").distinct()


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return pairs(a.select(*keys, "src", "tgt").union(b.select(*keys, "src", "tgt")), keys)


def _sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs of either, with whether ``a`` and ``b`` have them: one grouping, so that neither side is ever broadcast."""
    rows = a.select(*keys, "src", "tgt", F.lit(True).alias("_x")).union(b.select(*keys, "src", "tgt", F.lit(False).alias("_x")))
    return rows.groupBy(*keys, "src", "tgt").agg(F.bool_or("_x").alias("_a"), F.bool_or(~F.col("_x")).alias("_b"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sided(a, b, keys).filter("_b AND _a").select(*keys, "src", "tgt")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sided(a, b, keys).filter("_a AND NOT _b").select(*keys, "src", "tgt")


def flip(aln: DataFrame, keys: list[str]) -> DataFrame:
    return aln.select(*keys, F.col("tgt").alias("src"), F.col("src").alias("tgt"))


def nonzero(aln: DataFrame) -> DataFrame:
    return aln.filter("src > 0 AND tgt > 0")


def targets_of(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Each source's targets, in order."""
    return aln.groupBy(*keys, "src").agg(F.sort_array(F.collect_set("tgt")).alias("tgts"))


def with_nulls(aln: DataFrame, src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """Add (0, t) and (s, 0) for tokens (``idx``) without a partner."""
    lone_src = unaligned(src, aln, "src", keys).select(*keys, F.col("idx").alias("src"), F.lit(0).alias("tgt"))
    lone_tgt = unaligned(tgt, aln, "tgt", keys).select(*keys, F.lit(0).alias("src"), F.col("idx").alias("tgt"))
    return aln.select(*keys, "src", "tgt").union(lone_src).union(lone_tgt)


def unaligned(tokens: DataFrame, aln: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """Tokens (``idx``) that ``side`` of the alignment does not cover."""
    return tokens.join(wide(aln.select(*keys, F.col(side).alias("idx"))), [*keys, "idx"], "left_anti")


def _uncovered(candidates: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose source or target ``by`` does not cover."""
    s = by.select(*keys, "src").distinct().withColumn("_s", F.lit(True))
    t = by.select(*keys, "tgt").distinct().withColumn("_t", F.lit(True))
    return candidates.join(wide(s), [*keys, "src"], "left").join(wide(t), [*keys, "tgt"], "left").filter("_s IS NULL OR _t IS NULL").select(*keys, "src", "tgt")


def grow_diag(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The intersection, and its neighbours in the union whose source or target the intersection leaves open; one pass."""
    core = intersection(a, b, keys)
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in NEIGHBOURS))
    near = core.withColumn("d", F.explode(steps)).select(*keys, (F.col("src") + F.col("d.x")).alias("src"), (F.col("tgt") + F.col("d.y")).alias("tgt")).distinct()
    grown = _uncovered(near.join(wide(union(a, b, keys)), [*keys, "src", "tgt"], "left_semi"), core, keys)
    return union(core, grown, keys)


def final(now: DataFrame, a: DataFrame, keys: list[str]) -> DataFrame:
    """Add the pairs of ``a`` whose source or target ``now`` leaves open."""
    return union(now, _uncovered(a.select(*keys, "src", "tgt"), now, keys), keys)


def grow_diag_final(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    a, b = cut(pairs(a, keys)), cut(pairs(b, keys))  # each step reads its inputs several times
    now = cut(grow_diag(a, b, keys))
    return final(cut(final(now, a, keys)), b, keys)


SYMMETRIZERS = {"intersection": intersection, "union": union, "grow_diag": grow_diag, "grow_diag_final": grow_diag_final}


def refined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Och & Ney's refined combination; the open pairs are tried in the order (src, tgt), which makes it a function of its input."""
    import pandas as pd

    ship(a.sparkSession)
    both = a.select(*keys, "src", "tgt").distinct().withColumn("a", F.lit(1)).withColumn("b", F.lit(0))
    both = both.union(b.select(*keys, "src", "tgt").distinct().withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    both = both.groupBy(*keys, "src", "tgt").agg(F.min("a").alias("x"), F.max("a").alias("a"), F.max("b").alias("b"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        core = {(s, t) for s, t, x, y in zip(pdf.src, pdf.tgt, pdf.a, pdf.b) if x and y}
        rows, cols = {s for s, _ in core}, {t for _, t in core}
        for s, t in sorted((s, t) for s, t in zip(pdf.src, pdf.tgt) if (s, t) not in core):
            beside = (s - 1, t) in core or (s + 1, t) in core
            above = (s, t - 1) in core or (s, t + 1) in core
            if (s not in rows and t not in cols) or not (beside and above):
                core.add((s, t))
                rows.add(s)
                cols.add(t)
        out = pd.DataFrame(sorted(core), columns=["src", "tgt"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "src", "tgt"]]

    schema = both.select(*keys, "src", "tgt").schema
    return both.groupBy(*keys).applyInPandas(grow, schema)


def compose(ab: DataFrame, bc: DataFrame, keys: list[str]) -> DataFrame:
    """src of ``ab`` with tgt of ``bc`` over their shared middle."""
    return ab.select(*keys, "src", F.col("tgt").alias("mid")).join(wide(bc.select(*keys, F.col("src").alias("mid"), "tgt")), [*keys, "mid"]).select(*keys, "src", "tgt").distinct()


def positional(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One to one by position, for instances whose token tables are equally long."""
    na, nb = a.groupBy(*keys).agg(F.count("*").alias("n")), b.groupBy(*keys).agg(F.count("*").alias("n"))
    even = na.join(wide(nb), [*keys, "n"], "left_semi").select(*keys)
    return a.join(wide(even), keys, "left_semi").join(wide(b.select(*keys, "idx")), [*keys, "idx"]).select(*keys, F.col("idx").alias("src"), F.col("idx").alias("tgt"))


def matched(src: DataFrame, tgt: DataFrame, keys: list[str], form: Callable[[Column], Column] = F.lower, aligned: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """Greedy left-to-right alignment of tokens (``idx``, ``tok``) of equal form, added to ``aligned``.

    The n-th open source token of a form takes the n-th open target token of that form; with ``multi`` every source token
    still open then takes all targets of its form. This is what a scan with first-match-wins gives, as a window and a join.
    """
    s, t = src.withColumn("form", form(F.col("tok"))), tgt.withColumn("form", form(F.col("tok")))
    open_s, open_t = s, t
    if aligned is not None:
        open_s, open_t = unaligned(s, aligned, "src", keys), unaligned(t, aligned, "tgt", keys)
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join([*keys, 'form'])} ORDER BY idx)")
    left = open_s.withColumn("rn", rank).select(*keys, "form", "rn", F.col("idx").alias("src"))
    right = open_t.withColumn("rn", rank).select(*keys, "form", "rn", F.col("idx").alias("tgt"))
    out = left.join(wide(right), [*keys, "form", "rn"]).select(*keys, "src", "tgt")
    if aligned is not None:
        out = union(aligned, out, keys)
    if multi:
        rest = unaligned(s, out, "src", keys).select(*keys, "form", F.col("idx").alias("src"))
        out = union(out, rest.join(wide(t.select(*keys, "form", F.col("idx").alias("tgt"))), [*keys, "form"]).select(*keys, "src", "tgt"), keys)
    return out


def gram_matched(src: DataFrame, tgt: DataFrame, keys: list[str], aligned: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """As ``matched`` for the gloss table, whose matching is no equivalence: a fold over each instance's own candidates."""
    grams = src.sparkSession.createDataFrame([(g, w) for g, ws in GRAM_WORDS.items() for w in ws], "gram string, word string")
    open_s, open_t = src, tgt
    if aligned is not None:
        open_s, open_t = unaligned(src, aligned, "src", keys), unaligned(tgt, aligned, "tgt", keys)

    def candidates(s: DataFrame, t: DataFrame) -> DataFrame:
        s = s.select(*keys, F.lower("tok").alias("gram"), F.col("idx").alias("src")).join(F.broadcast(grams), "gram")  # a table of fixed size
        return s.join(wide(t.select(*keys, F.lower("tok").alias("word"), F.col("idx").alias("tgt"))), [*keys, "word"]).select(*keys, "src", "tgt").distinct()

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (y["src"] == x["src"]) | (y["tgt"] == x["tgt"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    rows = candidates(open_s, open_t).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("src", "tgt"))).alias("c"))
    kind = rows.schema["c"].dataType.simpleString()
    out = rows.select(*keys, F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("p")).select(*keys, "p.src", "p.tgt")
    if aligned is not None:
        out = union(aligned, out, keys)
    if multi:
        out = union(out, candidates(unaligned(src, out, "src", keys), tgt), keys)
    return out


def heuristic(src: DataFrame, tgt: DataFrame, keys: list[str], stem: bool = True, gram: bool = True, multi: bool = False, pos: bool = False) -> DataFrame:
    """Exact, then stem, then gram-table matches on lower-cased tokens; with ``pos`` equal ``label`` of what is left over."""
    out = cut(matched(src, tgt, keys, multi=multi))  # each step reads the one before several times
    if stem:
        out = cut(matched(src, tgt, keys, lambda x: stems(F.lower(x)), out, multi))
    if gram:
        out = cut(gram_matched(src, tgt, keys, out, multi))
    if pos:
        out = matched(src.withColumn("tok", F.col("label")), tgt.withColumn("tok", F.col("label")), keys, lambda x: x, out)
    return out


def morph_align(glosses: DataFrame, morphs: DataFrame, keys: list[str]) -> DataFrame:
    """Gloss units to language morphs inside each word, from left to right.

    ``glosses(idx, word_idx, gap)`` holds the characters up to the next gloss (null behind the last one); a boundary
    (``-``, ``=`` or white space) moves on to the word's next morph, and the last morph takes what is left.
    """
    word = f"PARTITION BY {', '.join([*keys, 'word_idx'])} ORDER BY idx"
    g = glosses.withColumn("move", F.when(F.trim(F.coalesce("gap", F.lit(""))).isin("", "-", "="), 1).otherwise(0))
    g = g.withColumn("at", F.expr(f"coalesce(sum(move) OVER ({word} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1"))
    m = morphs.withColumn("at", F.expr(f"row_number() OVER ({word})"))
    n = m.groupBy(*keys, "word_idx").agg(F.max("at").alias("n"))
    g = g.join(wide(n), [*keys, "word_idx"]).withColumn("at", F.least("at", "n"))
    return g.select(*keys, "word_idx", "at", F.col("idx").alias("src")).join(wide(m.select(*keys, "word_idx", "at", F.col("idx").alias("tgt"))), [*keys, "word_idx", "at"]).select(*keys, "src", "tgt")


def remap_morphs(triples: DataFrame, remap: DataFrame, keys: list[str]) -> DataFrame:
    """(morph, gloss, tgt) to gloss alignment and morph alignment, morphs renumbered by ``remap(morph, to)`` where it has them."""
    moved = triples.join(wide(remap), [*keys, "morph"], "left").withColumn("src", F.coalesce("to", "morph"))
    return moved.select(*keys, "src", "tgt").distinct()


def word_pairs(aln: DataFrame, src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """The aligned words themselves."""
    s, t = src.select(*keys, F.col("idx").alias("src"), F.col("tok").alias("src_tok")), tgt.select(*keys, F.col("idx").alias("tgt"), F.col("tok").alias("tgt_tok"))
    return aln.join(wide(s), [*keys, "src"]).join(wide(t), [*keys, "tgt"]).select(*keys, "src", "tgt", "src_tok", "tgt_tok")


def from_a3(line: Column) -> Column:
    """``NULL ({ 3 }) word ({ 1 2 }) ...`` as an array of (src, tgt), NULL being source 0."""
    sets = F.regexp_extract_all(line, F.lit(r"\(\{([^}]*)\}\)"), 1)
    each = F.transform(sets, lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), 0), lambda t: F.struct(i.cast("int").alias("src"), t.cast("int").alias("tgt"))))
    return F.flatten(each)


def serialize(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Each instance's pairs as ``s:t s:t ...``."""
    return aln.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("src", "tgt"))), lambda p: F.concat_ws(":", p["src"].cast("string"), p["tgt"].cast("string"))), " ").alias("alignment"))
