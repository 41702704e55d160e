"""Column functions over single lines: tokenizers, cleaners, judgments, gram forms.

All stay inside Spark's expressions. Cleaners that drop something overwrite it with blanks, so character columns keep
their places. White space and word classes are spelled out because Java's shorthands differ from Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"
NOT_WS = r"[^ \t\n\r\f\x0B]+"
LETTER = r"[\p{L}\p{N}_]"
SENTENCE = r"[\p{L}\p{N}_']+|\$[\p{Nd}.]+|" + NOT_WS
MORPH = r"[^ \t\n\r\f\x0B\-.:/()=]+"
# fixed values of the format
PUNCT = ".?!,Â"
GRAMS = ("3SG", "1PL", "2SG", "2PL")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it; keeps nested expressions linear in size."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def blank_match(x: Column, pattern: str) -> Column:
    """``x`` with every match of ``pattern`` overwritten by blanks."""

    def overwrite(v: Column) -> Column:
        gaps = F.concat(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(v, pattern, -1), gaps, lambda a, b: F.concat(a, b)), "")

    return bind(x, overwrite)


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_col(x), F.lit(NOT_WS), 0)


def sentence_tokens(x: Column | str) -> Column:
    """Word runs with apostrophes, dollar amounts, else single runs of anything but white space."""
    return F.regexp_extract_all(_col(x), F.lit(SENTENCE), 0)


def morphs(x: Column | str) -> Column:
    return F.regexp_extract_all(_col(x), F.lit(MORPH), 0)


def tagged(x: Column | str, delimiter: str = "/") -> Column:
    """``word/TAG`` tokens as an array of (form, label); the last delimiter splits."""
    pattern = F.lit(rf"([^ \t\n\r\f\x0B]+){delimiter}([^ \t\n\r\f\x0B]+)")
    return F.zip_with(F.regexp_extract_all(_col(x), pattern, 1), F.regexp_extract_all(_col(x), pattern, 2), lambda a, b: F.struct(a.alias("form"), b.alias("label")))


def with_offsets(x: Column | str, tokens: Column) -> Column:
    """Tokens in the order they stand in ``x`` as (tok, start, stop, idx); offsets are 0-based and half-open, idx counts from 1."""
    x = _col(x)

    def step(acc: Column, tok: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["stop"]).otherwise(F.lit(0))
        start = (F.call_function("locate", tok, x, last + 1) - 1).cast("int")
        return F.concat(acc, F.array(F.struct(tok.alias("tok"), start.alias("start"), (start + F.length(tok)).cast("int").alias("stop"), (F.size(acc) + 1).alias("idx"))))

    empty = F.array().cast("array<struct<tok:string,start:int,stop:int,idx:int>>")
    return F.aggregate(tokens, empty, step)


def grammaticality(x: Column) -> Column:
    return F.translate(x, "#*?", "   ")


def surrounding(x: Column) -> Column:
    """Blank quotes and opening brackets at the start, quotes, closing brackets and full stops at the end."""
    return blank_match(blank_match(x, rf"""^{WS}*['"`\[(]+"""), rf"""['"`\]).]+{WS}*$""")


def solo_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, f"[{PUNCT}]", " ")


def final_punctuation(x: Column) -> Column:
    return blank_match(x, f"[{PUNCT}]+$")


def split_punctuation(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, rf"({LETTER}+)([.?!,])+", "$1 $2"))


def external_punctuation(x: Column) -> Column:
    """Drop punctuation at the edges of words."""
    x = F.regexp_replace(x, rf"({LETTER}+)[{PUNCT}]+{WS}", "$1 ")
    x = F.regexp_replace(x, rf"(?:^|{WS})[{PUNCT}]+({LETTER}+)", "$1")
    return F.regexp_replace(x, rf"({LETTER}+)[{PUNCT}]+$", "$1 ")


def join_morphs(x: Column) -> Column:
    """Close up ``A . B`` and ``A - B``."""
    return F.regexp_replace(x, rf"({LETTER}){WS}*([.\-]){WS}*(?={LETTER})", "$1$2")


def fix_grams(x: Column) -> Column:
    """Rejoin person-number grams that white space has split."""
    for gram in GRAMS:
        for cut in range(1, len(gram)):
            x = F.regexp_replace(x, rf"(?i){gram[:cut]}{WS}+{gram[cut:]}", gram)
    return x


def rejoin(x: Column, letter: str, right: bool) -> Column:
    """Attach a letter that stands alone to the word on its right or left."""
    if right:
        return F.regexp_replace(x, rf"{WS}({letter}){WS}+({NOT_WS})", " $1$2")
    return F.regexp_replace(x, rf"({NOT_WS}){WS}+({letter}){WS}", "$1$2 ")


def numbering(x: Column) -> Column:
    """Blank (iv) (a) (1.a) anywhere and a. ii. 12 at the start."""
    x = blank_match(x, r"\((?:[ivx]+|[a-z]|[1-9.]+[a-z]?)\)")
    x = blank_match(x, rf"^{WS}*(?:[a-z]|[ivx]+)\.")
    return blank_match(x, rf"^{WS}*[0-9]+")


def ellipses(x: Column) -> Column:
    return F.regexp_replace(x, rf"\.{WS}*\.{WS}*\.", "")


def hyphens(x: Column) -> Column:
    return F.translate(x, "-=", "")


def leading_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"^\p{Punct}+", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+", " ")


def byte_mark(x: Column) -> Column:
    """Drop a leading b' that a bytes literal left behind."""
    return F.trim(F.regexp_replace(x, rf"""^b["']{WS}+""", ""))


def clean_lang(x: Column | str) -> Column:
    return F.translate(surrounding(numbering(_col(x))), "[]()", "    ")


def clean_gloss(x: Column | str) -> Column:
    x = fix_grams(join_morphs(_col(x)))
    x = rejoin(rejoin(x, "t", True), "h", False)
    return F.translate(final_punctuation(x), "#", " ")


def clean_trans(x: Column | str) -> Column:
    x = grammaticality(surrounding(solo_punctuation(_col(x))))
    return numbering(rejoin(rejoin(rejoin(x, "t", True), "h", False), "e", False))


_LEAD = rf"""^([ \t\n\r\f\x0B'"`]*)([?*])"""


def unjudged(x: Column | str) -> Column:
    """The line with its leading judgment mark blanked."""
    return F.regexp_replace(_col(x), _LEAD, "$1 ")


def judgment(x: Column | str) -> Column:
    """``*`` or ``?`` at the start of the line, with ``*`` appended if the rest has one; null if there is none."""
    mark = lambda v: F.concat(F.regexp_extract(v, _LEAD, 2), F.when(F.contains(unjudged(v), F.lit("*")), "*").otherwise(""))
    return F.nullif(bind(_col(x), mark), F.lit(""))


def hyphenate_infinitive(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), rf"(?i)to{WS}+({NOT_WS})", "to-$1")


def fix_gram(x: Column | str) -> Column:
    """``:`` and ``#`` to hyphens, white space gone."""
    return F.regexp_replace(F.translate(_col(x), ":#", "--"), f"{WS}+", "")


def gram_form(x: Column | str) -> Column:
    """A gram as features see it: lower case, fixed, the part before the last slash, one edge symbol stripped."""
    x = F.regexp_replace(fix_gram(F.lower(_col(x))), r"^(.*)/.*$", "$1")
    x = F.regexp_replace(x, r"^([^ \t\n\r\f\x0B]+)[\-=:\[(\])/*]$", "$1")
    return F.regexp_replace(x, r"^[\-=:\[(\])/*]([^ \t\n\r\f\x0B]+)$", "$1")


def valid_xml(x: Column | str) -> Column:
    """Characters that XML 1.0 forbids become blanks."""
    return F.regexp_replace(_col(x), r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", " ")


def slashtags(tokens: Column, delimiter: str = "/") -> Column:
    """(form, label) tokens as one line."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["form"], F.lit(delimiter), t["label"])), " ")


def untag(x: Column | str) -> Column:
    return F.array_join(F.transform(tagged(x), lambda t: t["form"]), " ")


def common_indent(lines: Column) -> Column:
    """An array of lines without their common leading white space."""
    indent = F.array_min(F.transform(lines, lambda s: F.length(F.regexp_extract(s, f"^{WS}*", 0))))
    return F.transform(lines, lambda s: F.substr(s, indent + 1))


def strict_columns(a: Column | str, b: Column | str) -> Column:
    """(src, tgt) of words of two lines of which one's columns contain the other's."""
    left, right = with_offsets(a, words(a)), with_offsets(b, words(b))

    def meets(x: Column, y: Column) -> Column:
        return ((x["start"] >= y["start"]) & (x["stop"] <= y["stop"])) | ((y["start"] >= x["start"]) & (y["stop"] <= x["stop"]))

    return F.flatten(F.transform(left, lambda x: F.transform(F.filter(right, lambda y: meets(x, y)), lambda y: F.struct(x["idx"].alias("src"), y["idx"].alias("tgt")))))


def span_contains(outer: Column, inner: Column) -> Column:
    """Whether every inner (s, e) lies in some outer one."""
    return F.forall(inner, lambda b: F.exists(outer, lambda a: (b["s"] >= a["s"]) & (b["e"] <= a["e"])))


def reference(item: Column, start: Column, stop: Column) -> Column:
    """The pointer ``id[s:e]``, or ``id`` where there is no span."""
    return F.when(start.isNull(), item).otherwise(F.format_string("%s[%d:%d]", item, start, stop))


def parse_reference(x: Column | str) -> Column:
    """``id``, ``id[s:e]``, ``a[..]+b[..]``, ``a,b`` as an array of (id, s, e)."""
    x = _col(x)
    whole = F.regexp_extract_all(x, F.lit(r"[A-Za-z][\w.\-]*(?:\[[^\]]*\])?"), 0)
    spans = F.transform(whole, lambda r: F.struct(F.regexp_extract(r, r"^[^\[]+", 0).alias("id"), F.regexp_extract_all(r, F.lit(r"(\d+):(\d+)"), 0).alias("spans")))
    one = lambda r: F.when(F.size(r["spans"]) == 0, F.array(F.struct(r["id"].alias("id"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e")))).otherwise(F.transform(r["spans"], lambda p: F.struct(r["id"].alias("id"), F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("s"), F.split_part(p, F.lit(":"), F.lit(2)).cast("int").alias("e"))))
    return F.flatten(F.transform(spans, one))


def same_word(a: Column | str, b: Column | str, lower: bool = True, stem: bool = True) -> Column:
    """Whether two words are equal, or equal in lower case, or of equal English stems."""
    from glosspark.functions.stem import stems

    a, b = _col(a), _col(b)
    out = a == b
    if lower:
        out = out | (F.lower(a) == F.lower(b))
    return out | (stems(F.lower(a)) == stems(F.lower(b))) if stem else out
