"""Columns with the names that operators use inside: nothing crashes, and their values come through."""

import corpus_pipeline
from glosspark.llm import mixing, rules, suffix

NAMES = ["u", "q", "p", "whole", "bucket", "edge", "key", "row", "id", "h", "s", "e", "spans", "_i", "_h", "_k", "_key", "_words", "_t", "_lang", "fill", "rest", "size", "copies"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"concat(doc_id, ':', '{n}') AS `{n}`" for n in NAMES))


def test_names(spark):
    words = " ".join(f"w{i}" for i in range(90))
    rows = [(1, words, "en", "a", 1), (2, words + " tail", "en", "a", 1), (3, None, None, None, None), (4, "", "de", "b", 0), (5, "other text " * 40, "de", "b", 1)]
    docs = documents(spark, rows)
    stages = [lambda d: corpus_pipeline.first_of_near_duplicates(spark, d, ""), lambda d: corpus_pipeline.without_repeated_passages(spark, d, ""), lambda d: corpus_pipeline.mixed(spark, d, "")]
    for stage in stages:
        for table in (docs, docs.filter("false")):
            out = stage(table)
            assert out.columns == docs.columns
            for r in out.collect():
                assert all(r[n] == f"{r.doc_id}:{n}" for n in NAMES)
    for out, replaced in ((mixing.mix(docs), mixing.KEYS), (rules.judge(docs), rules.OUTPUTS), (suffix.dedup(docs), ("n_bytes",))):
        got = out.collect()
        assert len(got) == len(rows)
        assert all(r[n] == f"{r.doc_id}:{n}" for r in got for n in NAMES if n not in replaced)


MORE = ["_l", "_e", "_m", "_b", "_row", "_stored", "media", "_x", "row", "id", "h", "spans", "_id", "_h"]


def more_documents(spark):
    words = " ".join(f"good{i}" for i in range(60))
    rows = [(i, f"{words} {i}" if i % 2 else "bad junk " * 20, "en" if i % 2 else "de", "a", 1) for i in range(40)] + [(50, None, None, None, None), (51, "", "", "", 0), (52, words, "en", "b", 2), (52, words, "en", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return len(rows), df.selectExpr("*", *(f"concat(doc_id, ':', '{n}') AS `{n}`" for n in MORE))


def test_more_names(spark, tmp_path):
    """The learnt operators, tokens, media and line removal, on nulls, empty texts and repeated rows."""
    from glosspark.llm import divergence, flac, langid, lines, merkle, minhash, pieces, quality, queries, toxicity

    n, docs = more_documents(spark)
    labels = docs.selectExpr("doc_id", "CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS quality", "CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS toxic").distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    path = queries.tokenizer_path()
    done = [
        quality.score_quality(docs, quality.train_quality(docs, labels)),
        langid.predict_languages(docs, langid.train_languages(docs)),
        toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)),
        pieces.encode_documents(docs, path),
        pieces.encode_digests(docs, path),
        flac.media_report(docs),
        lines.strip(docs),
    ]
    for out in done:
        got = out.collect()
        assert len(got) == n and all(r[c] == f"{r.doc_id}:{c}" for r in got for c in MORE)
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and all(r[c] == f"{r.doc_id}:{c}" for r in kept.collect() for c in MORE)
    assert corpus_pipeline.good_quality(spark, docs.filter("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.mixed(spark, docs, "").columns == docs.columns
    tokens = corpus_pipeline.encoded(spark, docs, "")
    assert tokens.count() == n and {r.doc_id for r in tokens.collect()} == {r.doc_id for r in docs.collect()}
    assert merkle.audit(docs).count() == minhash.report(docs).count() == n and divergence.audit(docs).filter("part = 'pair'").count() > 0


def test_invalid_bytes(spark):
    """Bytes that are no UTF-8 are read as replacement characters by the tokenizer and pass line removal as they are."""
    from glosspark.llm import lines, pieces, queries

    docs = spark.sql("SELECT id AS doc_id, CAST(unhex('61FF62') AS STRING) AS text FROM range(2)")
    got = pieces.encode_digests(docs.select("doc_id", "text"), queries.tokenizer_path()).select("n_tokens").collect()
    assert len(got) == 2 and all(r.n_tokens > 2 for r in got)
    assert [r.t.hex() for r in lines.strip(docs).selectExpr("CAST(text AS BINARY) AS t").collect()] == ["61ff62"] * 2
