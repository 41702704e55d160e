r"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles are its runs of ``SHINGLE`` = 5 words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; a text of fewer words has one
shingle of all its words. Each shingle is hashed once to 64 bits (XXH64 of its words' XXH64 values, seed 42): the upper 8 bits name one of
``BINS`` = 256 bins, and a bin holds the least of the other 56. Empty bins are filled by optimal densification: a bin tries others in a
random order of its own, the same for all texts, and copies the first that is not empty. That order is ``ATTEMPTS`` draws by hash; a text so short
that all of these are empty goes on with its filled bins in the order of the hash of (bin, filled bin). Of every bin the
low-order ``BITS`` = 8 bits are packed, so two bins that differ agree by chance with C = 1/256, and likeness is corrected for that:
with E the share of equal bins, (E - C) / (1 - C), at least 0.

Hashes and bins are arrays within a row: one sort of the hashes with a mark behind each bin leaves the least of each bin in front
of its range. Nothing is exploded, so no text meets another but in ``edited``: there each document's next one is found on
rows of (doc_id, hash, length) alone, and sends its first characters, at most half as many as its reader has, to that reader.

Defined results: a null text is empty; a text without words has the fingerprint '' and likeness 1 to its like, 0 to others;
equal texts have equal fingerprints; a null doc_id comes before all others; rows of equal doc_id follow the hash of their
texts, then their length, and repeated rows follow each other; a lone row is its own next; an empty table gives an empty table; other
columns, whatever their names, are ignored; very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.order import numbered
from glosspark.session import cut

SHINGLE = 5
BINS, BITS = 256, 8
ATTEMPTS = 12
FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     "  # A-Z, and all white space to blanks
LOW = (1 << 56) - 1  # below the bin's bits; as a value the mark of an empty bin
CHANCE = 1 / (1 << BITS)
KEY = ["k", "h", "n"]


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``, 32 packed BIGINTs, or none for a text without words.

    A step that reads an array more than once is a projection of its own, which keeps Catalyst from working the array out for each element.
    """
    own = rows.columns
    words = F.array_remove(F.split(F.translate(F.col(text), FROM, TO), " "), "")
    rows = rows.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    gram = ", ".join(f"_w[i + {k}]" for k in range(SHINGLE))
    grams = f"CASE WHEN size(_w) >= {SHINGLE} THEN transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64({gram})) WHEN size(_w) > 0 THEN array(xxhash64(_w)) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    marks = f"transform(sequence(-{BINS // 2}L, {BINS // 2 - 1}L), i -> shiftleft(i, 56) | {LOW}L)"
    rows = rows.select(*own, F.expr(f"sort_array(concat({grams}, {marks}))").alias("_h"))
    rows = rows.select(*own, F.expr("filter(_h, (x, i) -> i = 0 OR shiftright(x, 56) <> shiftright(_h[i - 1], 56))").alias("_least"))
    rows = rows.select(*own, F.expr(f"transform(_least, x -> CASE WHEN (x & {LOW}L) <> {LOW}L THEN x END)").alias("_v"), F.expr(f"filter(_least, x -> (x & {LOW}L) <> {LOW}L)").alias("_full"))
    draws = ", ".join(f"_v[CAST(pmod(xxhash64(i, {a}), {BINS}) AS INT)]" for a in range(ATTEMPTS))
    rest = "array_min(transform(_full, x -> struct(xxhash64(i, shiftright(x, 56)) AS o, x AS x))).x"
    rows = rows.select(*own, F.expr(f"CASE WHEN size(_full) > 0 THEN transform(_v, (x, i) -> coalesce(x, {draws}, {rest})) END").alias("_bins"))
    packed = f"transform(sequence(0, {BINS * BITS // 64 - 1}), j -> aggregate(slice(_bins, {64 // BITS} * j + 1, {64 // BITS}), 0L, (a, x) -> shiftleft(a, {BITS}) | (x & {(1 << BITS) - 1})))"
    return rows.select(*own, F.expr(f"CASE WHEN size(_bins) > 0 THEN {packed} ELSE CAST(array() AS ARRAY<BIGINT>) END").alias(name))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints."""
    fold = lambda x, k: x.bitwiseOR(F.shiftrightunsigned(x, k))
    # the lowest bit of each byte, into which all bits of the byte are folded
    off = F.zip_with(a, b, lambda x, y: F.bit_count(fold(fold(fold(x.bitwiseXOR(y), 4), 2), 1).bitwiseAND(F.lit(int("01" * 8, 16)))))
    equal = 1 - F.aggregate(off, F.lit(0), lambda s, x: s + x) / BINS
    measured = F.greatest(F.lit(0.0), (equal - CHANCE) / (1 - CHANCE))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), measured).otherwise((F.size(a) == F.size(b)).cast("double"))


def text_of(fingerprint: str) -> Column:
    """The packed bits in lower-case hex."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every row."""
    own = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return with_fingerprint(own, "text", "bits").select("doc_id", text_of("bits").alias("fingerprint"))


def followers(own: DataFrame) -> DataFrame:
    """``(k, h, n, copies, to_k, to_h, to_n)``: each distinct row of ``own(doc_id, k, h, n)`` and the one before it, behind the first the last."""
    nodes = own.groupBy("doc_id", *KEY).agg(F.count("*").alias("copies")).withColumn("all", F.lit(""))
    placed = cut(numbered(nodes, "all", ["doc_id", "h", "n"]).select(*KEY, "copies", "idx", "m"))
    before = placed.select(((F.col("idx") + 1) % F.col("m")).alias("idx"), *(F.col(c).alias(f"to_{c}") for c in KEY))
    return placed.join(before, "idx").select(*KEY, "copies", *(f"to_{c}" for c in KEY))


def edited(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint and that of its edited text, whose last half is the first characters of the next document.

    ``(doc_id, n_chars, edited, bits, edited_bits, next_bits, next_doc_id)``.
    """
    own = docs.select("doc_id", F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    own = own.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("")).alias("k"), F.xxhash64("text").alias("h"), F.char_length("text").alias("n"), "text")
    order = followers(own.drop("text"))
    one = with_fingerprint(own, "text", "bits").withColumn("rn", F.expr(f"row_number() OVER (PARTITION BY {', '.join(KEY)} ORDER BY k)")).filter("rn = 1").drop("rn")
    linked = one.join(order, KEY)
    start = lambda n: F.substring("text", F.lit(1), F.expr(f"{n} div 2").cast("int"))
    sent = linked.select(*(F.col(f"to_{c}").alias(c) for c in KEY), F.col("doc_id").alias("next_doc_id"), start("to_n").alias("next_start"), F.col("bits").alias("next_bits"))
    met = linked.join(sent, KEY)
    following = F.struct("next_doc_id", "next_start", "next_bits", F.lit(1).cast("bigint").alias("times"))
    itself = F.struct(F.col("doc_id").alias("next_doc_id"), start("n").alias("next_start"), F.col("bits").alias("next_bits"), (F.col("copies") - 1).alias("times"))
    each = F.explode(F.when(F.col("copies") > 1, F.array(following, itself)).otherwise(F.array(following)))  # a repeated row's next is its repeat, but for the last
    rows = met.select("doc_id", "text", "n", "bits", each.alias("x")).select("doc_id", "n", "bits", "x.*", F.concat(F.substring("text", F.lit(1), F.expr("n - n div 2").cast("int")), F.col("x.next_start")).alias("edited"))
    rows = with_fingerprint(rows.drop("next_start"), "edited", "edited_bits").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), "edited", "bits", "edited_bits", "next_bits", "next_doc_id")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and its edited text, and its likeness to that text and to the next document."""
    return edited(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of("bits").alias("fingerprint"), text_of("edited_bits").alias("edited_fingerprint"),
        likeness("bits", "edited_bits").alias("near_edited"), likeness("bits", "next_bits").alias("near_next"), "next_doc_id",
    )
