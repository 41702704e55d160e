"""Spark-first analytics for interlinear glossed text and line-structured corpora."""
