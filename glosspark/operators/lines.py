"""The line layer of an instance: raw lines to clean lines to one normal line per tag.

Lines are ``(igt_id, ord, item_id, tag, text[, judgment])``; a tag is a primary tag with ``+``-joined labels.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.session import ship

MAIN = ("L", "G", "T")


def has_label(tag: Column, label: str) -> Column:
    """Corrupt instances carry CR, two-column ones DB."""
    return F.array_contains(F.split(tag, r"[+\-]"), label)


def clean_lines(raw: DataFrame) -> DataFrame:
    """One line per primary tag in first-seen order: a lone line keeps its tag, several are concatenated under the primary tag."""
    rows = raw.withColumn("primary", F.split_part("tag", F.lit("+"), F.lit(1)))
    if "judgment" not in raw.columns:
        rows = rows.withColumn("judgment", F.lit(None).cast("string"))
    parts = F.sort_array(F.collect_list(F.struct("ord", "item_id", "tag", "text", "judgment")))
    g = rows.groupBy("igt_id", "primary").agg(parts.alias("p"))
    judged = F.filter(F.transform("p", lambda x: x["judgment"]), lambda j: j.isNotNull())
    return g.select(
        "igt_id",
        F.get("p", F.lit(0))["ord"].alias("ord"),
        F.when(F.size("p") == 1, F.get("p", F.lit(0))["tag"]).otherwise(F.col("primary")).alias("tag"),
        F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
        F.get(judged, F.lit(0)).alias("judgment"),
        F.transform("p", lambda x: x["item_id"]).alias("sources"),
    )


def cleaned(text: Column, tag: Column) -> Column:
    """The tag's cleaner."""
    return F.when(tag == "L", T.clean_lang(text)).when(tag == "G", T.clean_gloss(text)).when(tag == "T", T.clean_trans(text)).otherwise(text)


def normal_lines(clean: DataFrame) -> DataFrame:
    """The L, G and T line of each instance, cleaned before and after its judgment is taken out, without common indent.

    An instance with two lines of one tag has no normal line of it; look for such with ``ambiguous``.
    """
    rows = clean.withColumn("main", F.split_part("tag", F.lit("+"), F.lit(1))).filter(F.col("main").isin(*MAIN))
    alone = F.expr("count(*) OVER (PARTITION BY igt_id, main)")
    rows = rows.withColumn("_n", alone).filter("_n = 1")
    once = cleaned(F.col("text"), F.col("main"))
    rows = rows.withColumn("_once", once).withColumn("judgment", F.coalesce("judgment", T.judgment("_once"))).withColumn("text", cleaned(T.unjudged("_once"), F.col("main")))
    rows = rows.withColumn("_indent", F.expr(f"min(length(regexp_extract(text, '^{T.WS}*', 0))) OVER (PARTITION BY igt_id)".replace("\\", "\\\\")))
    return rows.select("igt_id", F.array_position(F.array(*map(F.lit, MAIN)), F.col("main")).alias("ord"), F.col("main").alias("tag"), F.expr("substring(text, _indent + 1)").alias("text"), "judgment")


def ambiguous(clean: DataFrame) -> DataFrame:
    """Instances with more than one line of a main tag."""
    main = F.split_part("tag", F.lit("+"), F.lit(1))
    return clean.filter(main.isin(*MAIN)).groupBy("igt_id", main.alias("tag")).agg(F.count("*").alias("n")).filter("n > 1")


def replace_lines(lines: DataFrame, new: DataFrame) -> DataFrame:
    """``lines`` with the instances of ``new`` taken from it instead."""
    return lines.join(new.select("igt_id").distinct(), "igt_id", "left_anti").unionByName(new, allowMissingColumns=True)


def _overlay(lines: list[str]) -> str:
    """Later lines' words put into blanks of the first where they fit; what starts behind its end is appended in place."""
    if not lines:
        return ""
    out = list(lines[0])
    for line in lines[1:]:
        for word in re.finditer(r"\S+", line):
            a, b = word.span()
            if a >= len(out):
                out += [" "] * (a - len(out)) + list(line[a:])
                break
            if b <= len(out) and all(c.isspace() for c in out[a:b]):
                out[a:b] = word.group()
    return "".join(out)


def merge_lines(lines: Column) -> Column:
    """An array of lines overlaid into one."""
    ship()

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _overlay(x) for x in rows.to_pylist()], pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(lines)
