"""Rows whose columns an operator passes through: packed beside the text, so that no name of theirs clashes with the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(row, text)``: all other columns in one struct."""
    others = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return docs.select(F.struct(*(others or [F.lit(0).alias("c")])).alias("row"), docs[f"`{text}`"].alias("text"))


def unpacked(docs: DataFrame, text: str | None = "text", without: tuple | list = ()) -> list[Column]:
    """The columns of ``docs`` in their order, less ``without``, out of a table with ``row`` and the text."""
    return [F.col("text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in without]


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def field(docs: DataFrame, name: str) -> Column:
    """A packed column of ``docs``."""
    return F.col(f"row.c{docs.columns.index(name)}")
