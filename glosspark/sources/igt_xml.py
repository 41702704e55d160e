"""Annotated instances in XML: nested documents to flat tables and back.

The schema is explicit, attributes stay strings, and comments are stripped before parsing because they would cut item text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = ("_type", "_line", "_tag", "_judgment", "_index", "_alignment", "_segmentation", "_content", "_source", "_target", "_dep", "_head", "_children", "`_ec-type`", "`_ec-pos`", "`_ec-dep`")
META = "ARRAY<STRUCT<_type STRING, meta ARRAY<STRUCT<_type STRING, _name STRING, `_iso-639-3` STRING, _tiers STRING, _source STRING, _method STRING, _date STRING, `_projected-from` STRING, `_token-type` STRING, _VALUE STRING>>>>"
ITEM = "ARRAY<STRUCT<_id STRING, " + ", ".join(f"{a} STRING" for a in ATTRIBUTES) + ", _VALUE STRING>>"
TIER = f"ARRAY<STRUCT<_id STRING, _type STRING, _state STRING, _alignment STRING, _segmentation STRING, _content STRING, _source STRING, _target STRING, _dep STRING, _head STRING, _children STRING, metadata {META}, item {ITEM}>>"
SCHEMA = f"_id STRING, `_doc-id` STRING, `_line-range` STRING, `_tag-types` STRING, metadata {META}, tier {TIER}"
OPTIONS = {"rowTag": "igt", "ignoreSurroundingSpaces": "false"}


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """Instances in a column of whole documents, one row each; the document's order is kept in ``igt_ord``."""
    bare = F.regexp_replace(F.col(column), r"(?s)<!--.*?-->", "")
    one = F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)<igt[\s>].*?</igt>"), 0)).alias("igt_ord", "x")
    return texts.select(*(c for c in texts.columns if c != column), one).select("*", F.from_xml("x", SCHEMA, OPTIONS).alias("igt")).select("igt_ord", "igt.*", *(c for c in texts.columns if c != column))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Instances of all files below a path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("corpus"), "value")
    return parse(files)


def loads(spark: SparkSession, text: str) -> DataFrame:
    return parse(spark.createDataFrame([(text,)], "value string"))


def instances(igt: DataFrame) -> DataFrame:
    return igt.select("igt_ord", F.col("_id").alias("igt_id"), F.col("`_doc-id`").alias("doc_id"), F.col("`_line-range`").alias("line_range"), F.col("`_tag-types`").alias("tag_types"))


def tiers(igt: DataFrame) -> DataFrame:
    """(igt_id, tier_ord, tier_id, type, state, alignment, segmentation, content, method, ...), one row a tier."""
    t = igt.select(F.col("_id").alias("igt_id"), F.posexplode("tier").alias("tier_ord", "t"))
    metas = F.flatten(F.transform(F.coalesce("t.metadata", F.array()), lambda m: m["meta"]))
    first = lambda f: F.get(F.filter(F.transform(metas, f), lambda x: x.isNotNull()), F.lit(0))
    return t.select(
        "igt_id", "tier_ord", F.col("t._id").alias("tier_id"), *(F.col(f"t._{c}").alias(c) for c in ("type", "state", "alignment", "segmentation", "content", "source", "target", "dep", "head", "children")),
        first(lambda m: m["_method"]).alias("method"), first(lambda m: m["_projected-from"]).alias("projected_from"), first(lambda m: m["_token-type"]).alias("token_type"),
    )


def items(igt: DataFrame) -> DataFrame:
    """(igt_id, tier_id, idx, item_id, text, attributes...), one row an item; idx counts from 1."""
    t = igt.select(F.col("_id").alias("igt_id"), F.explode("tier").alias("t"))
    i = t.select("igt_id", F.col("t._id").alias("tier_id"), F.col("t._type").alias("tier_type"), F.col("t._state").alias("state"), F.posexplode("t.item").alias("i", "x"))
    attrs = [F.col(f"x.{a}").alias(a.strip("`").removeprefix("_").replace("-", "_")) for a in ATTRIBUTES]
    return i.select("igt_id", "tier_id", "tier_type", "state", (F.col("i") + 1).alias("idx"), F.col("x._id").alias("item_id"), F.col("x._VALUE").alias("text"), *attrs)


def lines(item_table: DataFrame, state: str) -> DataFrame:
    """The line layer of a state (raw, cleaned, normalized), as the line operators take it."""
    return item_table.filter((F.col("tier_type") == "odin") & (F.col("state") == state)).select("igt_id", F.col("idx").alias("ord"), "item_id", "tag", "text", "judgment")  # the tier type is a fixed value of the format


def pairs(item_table: DataFrame, tier_type: str = "bilingual-alignments") -> DataFrame:
    """(igt_id, tier_id, source, target) of alignment items, comma-joined targets apart."""
    rows = item_table.filter(F.col("tier_type") == tier_type)
    return rows.select("igt_id", "tier_id", F.col("source").alias("source"), F.explode(F.split("target", ",")).alias("target"))


ITEM_COLUMNS = ("_id", *(a.strip("`") for a in ATTRIBUTES), "_VALUE")
TIER_COLUMNS = ("_id", "_type", "_state", "_alignment", "_segmentation", "_content", "_source", "_target", "_dep", "_head", "_children")


def with_tier(igt: DataFrame, item_table: DataFrame, kind: str, method: str | None = None, **attributes: str) -> DataFrame:
    """``igt`` with one more tier from ``item_table(igt_id, tier_id, idx, item_id, text, ..)``, whose further columns are item attributes.

    A tier of that id is replaced; instances without items keep their tiers.
    """
    known = {c.strip("`").removeprefix("_").replace("-", "_"): c for c in ITEM_COLUMNS} | {"item_id": "_id", "text": "_VALUE"}
    columns = {known[c]: c for c in item_table.columns if c in known and c not in ("id", "VALUE")}
    value = lambda name, given: F.col(given[name]).cast("string") if name in given else F.lit(None).cast("string")
    item = F.struct("idx", F.struct(*(value(c, columns).alias(c) for c in ITEM_COLUMNS)).alias("x"))
    held = item_table.groupBy(F.col("igt_id").alias("_id"), "tier_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("items"))
    given = {"_type": kind} | {f"_{k}": v for k, v in attributes.items()}
    fixed = [F.col("tier_id").alias("_id") if c == "_id" else F.lit(given.get(c)).cast("string").alias(c) for c in TIER_COLUMNS]
    meta = F.from_json(F.to_json(F.array(F.struct(F.lit("provenance").alias("_type"), F.array(F.struct(F.lit("provenance").alias("_type"), F.lit(method).alias("_method"))).alias("meta")))), META) if method else F.lit(None).cast(META)
    tiers_of = held.select(F.col("_id").alias("_of"), F.struct(*fixed, meta.alias("metadata"), F.col("items").cast(ITEM).alias("item")).cast(TIER[6:-1]).alias("t"))
    out = igt.join(tiers_of, igt["_id"] == F.col("_of"), "left")
    mine = F.filter(F.coalesce("tier", F.array().cast(TIER)), lambda t: t["_id"] != F.col("t")["_id"])
    return out.withColumn("tier", F.when(F.col("t").isNull(), F.col("tier")).otherwise(F.concat(mine, F.array("t")))).drop("t", "_of")


def write(igt: DataFrame, path: str) -> None:
    """Instances back to XML, one file a partition."""
    keep = [c for c in ("_id", "_doc-id", "_line-range", "_tag-types", "metadata", "tier") if c in igt.columns]
    igt.select(*(F.col(f"`{c}`") for c in keep)).write.format("xml").option("rootTag", "xigt-corpus").option("rowTag", "igt").save(path)
