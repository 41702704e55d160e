"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.llm import divergence, flac, langid, lines, merkle, minhash, mixing, pieces, quality, rules, simhash, suffix, toxicity
from glosspark.llm.samples import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return quality.score_quality(rows, model).select("doc_id", "held_out", "score", "predicted")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_languages(docs)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return langid.predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public byte-pair model lies; ``pieces`` takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return toxicity.score_toxicity(rows, model).select("doc_id", "held_out", "score", "predicted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).drop("text")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 for whole lines of any length."""
    return lines.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", min_words=1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_suffix, op3_langid, op4_simhash, op5_toxicity, op6_sentencepiece, op7_rules, op8_lines, op8_lines_all, op9_mixing, op10_flac, op11_divergence, op12_minhash, op13_merkle)}
ORACLES: dict[str, str] = {"op7_rules": rules.oracle(), "op8_lines": lines.ORACLE, "op8_lines_all": lines.ORACLE_ALL, "op9_mixing": mixing.ORACLE, "op11_divergence": divergence.ORACLE, "op13_merkle": merkle.ORACLE}
