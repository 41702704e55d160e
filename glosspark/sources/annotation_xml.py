"""Tool-made annotation XML (TextTier, SegTier, AlignmentTier, PosTagTier) to flat tables.

Each file is parsed once into element rows in Arrow batches; references between elements are resolved by joins.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.session import ship

ROW = "corpus string, igt_ord int, kind string, id string, ord int, tag string, text string, source string, target string, from_char int, to_char int"


def _name(value: str | None) -> str | None:
    """``{x:Reference _seg_1}`` and ``seg_1`` name the same element."""
    if value is None:
        return None
    m = re.search(r"_(\S+?)\}?$", value)
    return (m.group(1) if m and "{" in value else value).replace("_", "").rstrip("}")


def _elements(corpus: str, text: str):
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    attr = lambda e, n: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == n), None)
    number = lambda v: int(v) if v is not None else None
    instances = [e for e in ElementTree.fromstring(text).iter() if local(e) == "Igt"]
    for i, igt in enumerate(instances, 1):
        for tier in igt.iter():
            kind, tid = local(tier), _name(attr(tier, "Name"))
            if kind == "TextTier" and attr(tier, "Text") is not None and "odin-txt" not in (attr(tier, "TierType") or ""):
                yield corpus, i, "line", tid, 1, (attr(tier, "TierType") or "").split("-")[0], attr(tier, "Text"), None, None, None, None
            parts = [e for e in tier.iter() if local(e) in ("SegPart", "AlignPart", "TagPart")] if kind in ("SegTier", "AlignmentTier", "PosTagTier") else []
            for n, part in enumerate(parts, 1):
                pid, src = _name(attr(part, "Name")), _name(attr(part, "Source"))
                if local(part) == "SegPart":
                    yield corpus, i, "word", pid, n, None, attr(part, "Text"), _name(attr(part, "SourceTier") or attr(tier, "SourceTier")) or src, tid, number(attr(part, "FromChar")), number(attr(part, "ToChar"))
                elif local(part) == "TagPart":
                    yield corpus, i, "tag", pid, n, None, attr(part, "Text"), src, tid, None, None
                else:
                    for ref in part.iter():
                        if local(ref) == "Reference" and ref.text:
                            yield corpus, i, "pair", pid, n, None, None, src, _name("{" + ref.text.strip()) if ref.text.strip().startswith("_") else _name(ref.text.strip()), None, None


def load(spark: SparkSession, path: str) -> DataFrame:
    """All elements of all files below a path."""
    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("corpus"), "value")

    def run(batches):
        for pdf in batches:
            rows = [r for c, v in zip(pdf.corpus, pdf.value) for r in _elements(c, v)]
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in ROW.split(", ")])
            yield out.astype({"from_char": "Int32", "to_char": "Int32"})

    return files.mapInPandas(run, ROW)


KEY = ["corpus", "igt_ord"]


def lines(elements: DataFrame) -> DataFrame:
    return elements.filter("kind = 'line'").select(*KEY, F.col("id").alias("line_id"), "tag", "text")


def words(elements: DataFrame) -> DataFrame:
    """Segments with the tag of the line that they cut and their text, from the offsets where it is not given."""
    w = elements.filter("kind = 'word'").select(*KEY, F.col("id").alias("word_id"), F.col("ord").alias("idx"), F.col("source").alias("line_id"), F.col("text").alias("_t"), "from_char", "to_char")
    j = w.join(lines(elements), [*KEY, "line_id"], "left")
    return j.select(*KEY, "word_id", "idx", "tag", F.coalesce("_t", F.expr("substring(text, from_char + 1, to_char - from_char)")).alias("tok"), F.col("from_char").alias("start"), F.col("to_char").alias("stop"))


def pairs(elements: DataFrame) -> DataFrame:
    """Alignments as (src, tgt) word positions, target words being the alignment's source side."""
    w = words(elements).select(*KEY, "word_id", "idx")
    p = elements.filter("kind = 'pair'").select(*KEY, "source", "target")
    j = p.join(w.withColumnsRenamed({"word_id": "target", "idx": "src"}), [*KEY, "target"]).join(w.withColumnsRenamed({"word_id": "source", "idx": "tgt"}), [*KEY, "source"])
    return j.select(*KEY, "src", "tgt").distinct()


def tags(elements: DataFrame) -> DataFrame:
    """(idx, tok, label) of tagged words."""
    t = elements.filter("kind = 'tag'").select(*KEY, F.col("source").alias("word_id"), F.col("text").alias("label"))
    return words(elements).join(t, [*KEY, "word_id"]).select(*KEY, "idx", "tag", "tok", "label")
