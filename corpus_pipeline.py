"""The training-corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Stage results are written as Parquet and reread, so a lost executor costs no more than a stage;
shuffle files of a step go when it is written.

Defined results: rows with null or empty texts are scored, linked, mixed and encoded like any other; an empty table
gives an empty table; a column that ``documents`` does not have passes through every stage but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.llm import mixing, pieces, quality, shingles, suffix
from glosspark.llm.queries import tokenizer_path
from glosspark.session import brief_shuffles, shared_folder

#: No SQL states a learnt classifier, XXH64 shingles or the tokenizer; tests/llm holds stages against brute force.
ORACLE_SQL = None

#: Bytes of a repeated passage: under the length of 50 words, which is some 300.
PASSAGE = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on this input's own labelled rows, does not reject."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = docs.select(F.struct("*").alias("_row"), "text")
    return quality.score_quality(named, model).filter("predicted = 1").select("_row.*")


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles at a similarity of 0.8 or more."""
    with brief_shuffles(spark):
        out = shingles.keep_first(docs)
    return out.select("*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE bytes that stand elsewhere too, but for one occurrence; n_chars follows the text."""
    with brief_shuffles(spark):
        out = suffix.strip(docs, length=PASSAGE, first=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_copies(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the source span of each piece, for every row."""
    out = pieces.encode_documents(docs.select("doc_id", "source", "text"), tokenizer_path())
    return out.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "ends")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", first_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("tokens", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        with brief_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
