"""Held-out folds and bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """Whether a row is kept from training; a null id has no label and is not held out."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: int = 4, remainder: int = 2) -> DataFrame:
    """At most ``limit`` training rows ``(doc_id, label, text, place)``, chosen by the hash of the id.

    The ids are chosen before any text is touched. A doc_id labelled twice has its smallest label; a doc_id
    that several documents share gives one row. Ids may be of any type that has a text form.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != remainder))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id")), "doc_id")
        .limit(limit)
    )
    return one_text(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "label")


def one_text(rows: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label, text, place)``: of the texts that share an id that of the smallest hash, and the row's place in training."""
    one = rows.groupBy("doc_id", label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", label, "t.text", F.xxhash64(F.lit(1), F.col("doc_id")).alias("place"))
