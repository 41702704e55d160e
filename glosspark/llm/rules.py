"""Quality rules by distribution divergence, in DataFrame functions only.

Each text's histogram over character classes and over its language's common words is compared with the language's
reference, the sum of the histograms of all its texts, by Jensen-Shannon distance (base 2, so 0 to 1). A text is dropped
whose distance passes ``MAX_CHAR`` or, with at least ``MIN_WORDS`` words, ``MAX_WORD``; under ``MIN_CHARS`` characters or
``MIN_WORDS`` words the sample is too small for a verdict and the rule keeps it. Beside that stand base counts of words,
characters, symbols, repeated lines and repeated three-word windows, and a base rule on them.

Everything is computed inside the row: repeated windows by sorting the row's own window hashes (64 bits), so no text and no
word is shuffled; only one narrow row per document meets the references, of which there is one per language.

Defined results: null and empty texts have zero counts, fail the base rule and are not kept; a null language has a
reference of its own; repeated rows agree; an empty table gives an empty table; extra columns pass through (an input
column with an output's name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.rows import field, packed, unpacked
from glosspark.session import cut

# fixed values: frequent function words
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at", "are", "this", "have", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "il"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero"],
}
SLOTS = 25
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR, MAX_WORD = 0.3, 0.32
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def common_words(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for code, words in COMMON.items():
        out = F.when(lang == code, F.array(*map(F.lit, words))).otherwise(out)
    return out


def _less(longer: Column, shorter: Column) -> Column:
    return (F.length(longer) - F.length(shorter)).cast("bigint")


def measures(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the base counts and the two histograms ``_chars`` and ``_common``; without ``text``."""
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    rows = rows.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), 0)).withColumn("_known", common_words(F.col(lang)))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_rest", F.regexp_replace("_t", r"\p{L}+", ""))
    # each step below reads an array of the step before more than once, which keeps Catalyst from working it out anew per element
    rows = rows.withColumn("_h", F.expr("CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i)) END"))
    rows = rows.withColumn("_h", F.sort_array("_h"))
    rows = rows.withColumn("_at", F.expr("sort_array(transform(filter(_h, (x, j) -> (j > 0 AND _h[j - 1].h = x.h) OR (j < size(_h) - 1 AND _h[j + 1].h = x.h)), x -> x.i))"))
    rows = rows.withColumn("_hits", F.expr("filter(transform(_words, w -> lower(w)), w -> array_contains(_known, w))"))
    size = F.size("_words").cast("bigint")
    letters, upper = _less(F.col("_t"), F.col("_rest")), _less(F.col("_t"), F.regexp_replace("_t", r"\p{Lu}+", ""))
    digits = _less(F.col("_rest"), F.regexp_replace("_rest", r"\p{Nd}+", ""))
    blanks = _less(F.col("_rest"), F.regexp_replace("_rest", r"[\x20\x09-\x0D]+", ""))
    points = _less(F.col("_rest"), F.translate("_rest", ".,;:!?'\"()-", ""))
    symbols = _less(F.col("_t"), F.translate("_t", SYMBOLS, ""))
    other = F.length("_t").cast("bigint") - letters - digits - blanks - points - symbols
    repeated = F.expr("CASE WHEN size(_at) > 0 THEN aggregate(transform(_at, (p, j) -> IF(j = 0, 3, least(3, p - _at[j - 1]))), 0, (a, x) -> a + x) ELSE 0 END").cast("bigint")
    counted = F.transform("_known", lambda c: F.size(F.filter("_hits", lambda w: w == c)).cast("bigint"))
    rows = rows.select(
        *(F.col(c) for c in docs.columns if c not in (text, *OUTPUTS)),
        size.alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.array(upper, letters - upper, digits, blanks, points, symbols, F.greatest(other, F.lit(0).cast("bigint"))).alias("_chars"),
        F.when(F.size("_known") > 0, F.concat(counted, F.array(size - F.size("_hits")))).alias("_common"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two count arrays as distributions; null if either is missing or empty."""
    return F.expr(f"""
        sqrt(greatest(0D, aggregate(zip_with(
            transform({counts}, x -> try_divide(CAST(x AS DOUBLE), CAST(aggregate({counts}, 0L, (a, y) -> a + y) AS DOUBLE))),
            transform({reference}, x -> try_divide(CAST(x AS DOUBLE), CAST(aggregate({reference}, 0L, (a, y) -> a + y) AS DOUBLE))),
            (p, q) -> 0.5D * ((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) WHEN p = 0 THEN 0D END) + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) WHEN q = 0 THEN 0D END))
        ), 0D, (a, x) -> a + x)))""")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without ``text``, with the base counts, base_failed, the two distances and kept."""
    rows = cut(measures(packed(docs, text).withColumn("lang", field(docs, lang))))
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(SLOTS + 1)]
    refs = rows.filter("NOT base_failed").groupBy(F.col("lang").alias("_lang")).agg(*sums)
    refs = refs.select("_lang", F.array(*(F.col(f"c{i}") for i in range(7))).alias("_char_ref"), F.when(F.col("w0").isNotNull(), F.array(*(F.col(f"w{i}") for i in range(SLOTS + 1)))).alias("_word_ref"))
    out = rows.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = out.withColumn("char_distance", distance("_chars", "_char_ref")).withColumn("word_distance", distance("_common", "_word_ref"))
    chars = F.expr("aggregate(_chars, 0L, (a, x) -> a + x)")
    odd = ((chars >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).select(*unpacked(docs, text, without=(text, *OUTPUTS)), *OUTPUTS)


def oracle() -> str:
    """The base counts and the verdict in DuckDB SQL."""
    quoted = {code: "[" + ", ".join(f"'{w}'" for w in words) + "]" for code, words in COMMON.items()}
    known = "CASE lang " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in quoted.items()) + " ELSE [] END"
    parts = {"c": [f"sum(c[{i}])" for i in range(1, 8)], "o": [f"sum(o[{i}])" for i in range(1, SLOTS + 2)]}

    def js(own: str, ref: str, n: int) -> str:
        p, q = f"({own}[i] / list_sum({own})::DOUBLE)", f"({ref}[i] / list_sum({ref})::DOUBLE)"
        one = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: 0.5 * ({one.format(a=p, b=q)} + {one.format(a=q, b=p)})))))"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {known} AS known,
                  regexp_replace(coalesce(text, ''), '\p{{L}}+', '', 'g') AS rest FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM n WHERE n > 1) GROUP BY rid),
b AS (SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(t) - length(rest) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(rest, '[^\p{{Nd}}]+', '', 'g')) AS digits,
             length(regexp_replace(rest, '[^\x20\x09-\x0D]+', '', 'g')) AS blanks, length(regexp_replace(rest, '[^.,;:!?''"()\-]+', '', 'g')) AS points,
             list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(known, x)) AS hits FROM d LEFT JOIN r USING (rid)),
h AS (SELECT *, [upper, letters - upper, digits, blanks, points, n_symbols, length(t) - letters - digits - blanks - points - n_symbols] AS c,
             CASE WHEN len(known) > 0 THEN list_concat(list_transform(known, lambda k: len(list_filter(hits, lambda x: x = k))), [n_words - len(hits)]) END AS o,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
f AS (SELECT lang AS l, [{", ".join(parts["c"])}] AS rc, [{", ".join(parts["o"])}] AS ro FROM h WHERE NOT base_failed GROUP BY lang),
j AS (SELECT h.*, {js("c", "rc", 7)} AS cd, CASE WHEN o IS NOT NULL THEN {js("o", "ro", SLOTS + 1)} END AS wd FROM h LEFT JOIN f ON h.lang IS NOT DISTINCT FROM f.l)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((length(t) >= {MIN_CHARS} AND cd > {MAX_CHAR}) OR (n_words >= {MIN_WORDS} AND wd > {MAX_WORD}), false) AS kept FROM j
"""
