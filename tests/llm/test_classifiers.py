"""Quality, language and toxicity classifiers: held-out accuracy and edge cases."""

import random

import numpy as np
import pytest

from glosspark.llm import langid, quality, toxicity

GOOD = "the river runs past old houses and people walk along its banks every morning".split()
LANGS = {"en": "the of and with house water walking thing", "de": "der und nicht haus wasser gehen schön straße", "fr": "le les maison avec eau être où château", "es": "el los casa con agua niño corazón más"}


def words(rng, pool, n):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 4 == 0
        text = words(rng, GOOD, 60)
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            text += " you vilegrub " + words(rng, GOOD, 5)
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "a text without id"), (1002, "x" * 300_000), (1002, "x" * 300_000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    ours = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < 400 and truth[r.doc_id] is not None]
    assert np.mean([a == b for a, b in ours]) > 0.98
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert quality.train_quality(docs, labels).weights.tolist() == model.weights.tolist()


def test_no_labels(spark, corpus):
    docs, labels = corpus
    model = quality.train_quality(docs, labels.filter("false"))
    assert {r.score for r in quality.score_quality(docs, model).select("score").collect()} == {0.5}
    assert quality.score_quality(docs.filter("false"), model).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels.filter("false"))).select("score").collect()} == {0.5}


def test_clashing_columns(spark, corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    odd = docs.withColumn("score", F.lit("old")).withColumn("predicted", F.lit("old")).withColumn("lang_pred", F.lit("old"))
    out = quality.score_quality(odd, quality.FtrlModel(np.zeros(1 << quality.BITS, np.float32), 0.0))
    assert dict(out.dtypes)["score"] == "double" and out.count() == 405


def test_toxicity(spark, corpus):
    docs, labels = corpus
    rows = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
    hits = {r.doc_id for r in rows if r.predicted and r.doc_id is not None}
    assert hits == {i for i in range(400) if i % 4 == 0}


def test_languages(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, LANGS[lang].split(), 25), lang) for i, lang in enumerate(list(LANGS) * 60)]
    docs += [(900, None, "en"), (901, "", None), (902, "12 — 3", "de"), (903, "é", None), (None, "the water of the house", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train_languages(df)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    got = {r.doc_id: r for r in langid.predict_languages(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in docs[:240]]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.train_languages(df.filter("false"))
    assert {r.lang_pred for r in langid.predict_languages(df, none).collect()} == {"und"}
