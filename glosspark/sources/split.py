"""Lines and blocks of files of any size, read in byte ranges.

A file's lines come from all its ranges at once. A line's number is its place in its range and the lines of the ranges before,
one number per range; running sums, the line before, and blocks that go on in the next range are put together alike, so no task holds more
than a range or a block. Numbers equal those of reading each file whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = ["file", "split"]
ORDER = "(PARTITION BY file, split ORDER BY line)"
EARLIER = "(PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(file, split, line, text) of every file under a path; lines count from 0 and end at ``\\n`` or ``\\r\\n``."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_at"), "value")
    sums = rows.groupBy(*RANGE).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.expr(f"coalesce(sum(_n) OVER {EARLIER}, 0)"))
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return rows.join(sums, RANGE).select(*RANGE, (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"), F.regexp_replace(text, r"\r$", "").alias("text"))


def running(rows: DataFrame, value: Column, name: str, how: str = "sum") -> DataFrame:
    """``rows(file, split, line, ..)`` with the sum or maximum of ``value`` over the file's lines up to this one."""
    own = rows.withColumn("_v", value)
    sums = own.groupBy(*RANGE).agg(F.expr(f"{how}(_v)").alias("_s")).withColumn("_before", F.expr(f"{how}(_s) OVER {EARLIER}")).select(*RANGE, "_before")
    joined = own.withColumn("_own", F.expr(f"{how}(_v) OVER {ORDER}")).join(sums, RANGE)
    total = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_own", "_before")
    return joined.withColumn(name, total).drop("_v", "_own", "_before")


def line_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with ``value`` of the line before; null on a file's first line."""
    own = rows.withColumn("_v", value)
    last = own.groupBy(*RANGE).agg(F.max_by("_v", "line").alias("_l")).withColumn("_before", F.expr("lag(_l) OVER (PARTITION BY file ORDER BY split)")).select(*RANGE, "_before")
    joined = own.withColumn("_prev", F.expr(f"lag(_v) OVER {ORDER}")).withColumn("_top", F.expr(f"row_number() OVER {ORDER} = 1")).join(last, RANGE)
    return joined.withColumn(name, F.when(F.col("_top"), F.col("_before")).otherwise(F.col("_prev"))).drop("_v", "_prev", "_top", "_before")


def blocks(rows: DataFrame) -> DataFrame:
    """(file, block, text): parts between blank lines, counted from 0; a block's first line loses its indent unless it begins the file's first block."""
    blank = F.col("text").rlike(r"^[ \t]*$")
    marked = line_before(rows, blank, "gap").withColumn("opens", ~blank & F.coalesce("gap", F.lit(True)))
    held = running(marked, F.col("opens").cast("int"), "block").filter(~blank)
    text = F.when(F.col("opens") & (F.col("block") > 1), F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text"))
    joined = held.select("file", "block", "line", text.alias("text")).groupBy("file", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    last = joined.groupBy("file").agg(F.max("block").alias("_last"))
    return joined.join(last, "file").select("file", (F.col("block") - 1).cast("int").alias("block"), F.when(F.col("block") == F.col("_last"), F.regexp_replace("text", r"\s+$", "")).otherwise(F.col("text")).alias("text"))
