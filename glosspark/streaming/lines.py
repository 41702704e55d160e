"""Streaming forms of the stateless line operators, and watermarked counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators.lines import cleaned
from glosspark.sources.tagged import parse_records


def record_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New record files under ``path``, parsed to line rows; at most ``files`` files a batch."""
    texts = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True)
    return parse_records(texts)


def clean_stream(rows: DataFrame) -> DataFrame:
    """Cleaned text by primary tag, row by row: no state."""
    main = F.split_part("tag", F.lit("+"), F.lit(1))
    return rows.withColumn("text", cleaned(F.col("text"), main))


def tag_counts(events: DataFrame, ts: str, tag: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tags counted by tumbling window; rows later than the watermark are left out and state is dropped behind it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), tag).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), tag, "n")
