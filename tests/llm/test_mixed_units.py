"""Removal by pieces and lines together: planted passages, common lines, rows that a short hash can't tell apart."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glosspark.llm import lines, queries


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]


def wrapped(rng, ws):
    out = []
    while ws:
        n = rng.randint(9, 14)
        out.append(" ".join(ws[:n]))
        ws = ws[n:]
    return "\n".join(out)


@pytest.mark.parametrize("wrap", [False, True])
def test_planted_passages(spark, wrap):
    """Of 60 words in foreign text some five at either end stay, however the text is wrapped."""
    rng = random.Random(1)
    passages, docs, planted = [words(rng, 60) for _ in range(50)], [], {}
    for i in range(200):
        before, after = words(rng, rng.randint(0, 60)), words(rng, rng.randint(0, 60))
        ws = before + passages[i % 50] + after
        text = wrapped(rng, ws) if wrap else " ".join(ws)
        docs.append((i, text))
        planted[i] = set(passages[i % 50])
    left = {r.doc_id: r.text.split() for r in lines.strip(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lost = [1 - sum(w in planted[i] for w in left[i]) / 60 for i in range(50, 200)]
    assert sum(lost) / len(lost) > 0.75 and sum(x >= 0.5 for x in lost) / len(lost) > 0.95
    foreign = [len(set(t.split()) - planted[i] - set(left[i])) for i, t in docs]  # a word by itself may be a repeated piece beside the passage
    assert max(foreign) <= 2 and sum(foreign) < 20


def test_common_line_stays_once(spark):
    rng = random.Random(2)
    hot = "this short line of nine words is everywhere Here"
    docs = [(i, "\n".join([" ".join(words(rng, rng.randint(5, 30))), *([hot if i % 2 else hot.upper()] * (i % 3 == 0)), " ".join(words(rng, 8)), "two words"])) for i in range(90)]
    left = sorted(lines.strip(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert sum(hot.lower() in r.text.lower() for r in left) == 1 and hot.lower() in left[0].text.lower()
    assert all("two words" in r.text for r in left)  # under four words
    assert {r.unit for r in lines.repeated_units(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {"line"}


def test_texts_of_equal_short_hashes(spark):
    """Rows without ids whose texts agree in a 32-bit hash: only what is repeated goes."""
    texts = spark.range(300_000).select(F.concat(F.lit("alone words of text number "), F.col("id").cast("string"), F.lit(" and nothing else")).alias("text"))
    pair = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t[:2]
    line = "a line that is said again and again"
    docs = spark.createDataFrame([(None, f"{pair[0]}"), (None, pair[1]), (1, f"{line}\nx"), (2, f"{line}\ny")], "doc_id long, text string")
    assert {r.text for r in lines.strip(docs).collect()} == {pair[0], pair[1], f"{line}\nx", "y"}


def test_invalid_bytes(spark):
    docs = spark.sql("SELECT id AS doc_id, CASE WHEN id < 2 THEN CAST(unhex('6120622063206420FF0A78') AS STRING) ELSE 'q' END AS text FROM range(3)")
    got = {r.doc_id: r.t.hex() for r in lines.strip(docs).selectExpr("doc_id", "CAST(text AS BINARY) AS t").collect()}
    assert got == {0: "6120622063206420ff0a78", 1: "78", 2: "71"}


def test_against_sql(spark, tmp_path):
    rng = random.Random(4)
    passage, line = words(rng, 50), " ".join(words(rng, 6))
    docs = [(i // 2 if i % 7 else None, wrapped(rng, words(rng, rng.randint(0, 30)) + passage * (i % 3 == 0)) + f"\n{line}\n" * (i % 2) + rng.choice(["", "\n", " "])) for i in range(60)] + [(200, None), (201, "")]
    docs = list({d: None for d in docs})
    rows = [d for d in docs if d[0] is not None]  # the order of rows of one id, or of none, is by hash here and by text there
    rows = list({d[0]: d for d in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(lines.ORACLE).fetchall()}
    got = [tuple(r) for r in queries.op8_lines(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {r[1] for r in got} == {"run", "line"}
    assert os.path.isdir(f"{tmp_path}/documents.parquet")
