"""Language identification and toxicity: held-out accuracy, odd rows, too little to learn from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import langid, toxicity
from hearsay.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def remainder(doc, mod):
    return zlib.crc32(str(doc).encode()) % mod


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op5_language_id"](spark, FOLDER).collect()
    assert {r.doc_id for r in found} == set(truth)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_language_of_odd_rows(model, odd_docs, no_docs):
    docs = odd_docs.withColumn("score", F.lit("clash"))
    found = langid.predict(docs, model).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score <= 1
    assert langid.predict(no_docs, model).count() == 0


def test_nothing_to_learn_languages_from(odd_docs, no_docs):
    model = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, model).collect()} == {"und"}
    one = langid.fit(odd_docs.where("lang = 'en'"))
    letters = [r for r in langid.predict(odd_docs, one).collect() if r.lang_pred != "und"]
    assert letters and {r.lang_pred for r in letters} == {"en"}


def test_rare_languages_are_learned(spark):
    rows = [(i, "en", f"the house number {i} stands by the river") for i in range(2000)]
    rows += [(1, "en", "the house number 1 stands by the river")] * 100
    rows += [(3000 + i, "fi", f"talo numero {i} on joen rannalla") for i in range(3)]
    rows += [(4000 + i, "ja", f"{i}") for i in range(200)] + [(5000, "ja", "川のそばの家")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = langid.fit(docs, 20)
    assert sorted(sum(model.languages.values(), [])) == ["en", "fi", "ja"]
    found = langid.predict(docs.where("lang != 'ja' or doc_id = 5000"), model)
    assert found.where("lang_pred != lang").count() == 0


def test_a_frequent_language_does_not_meet_in_one_task(spark):
    """What reaches the window of a language is about twice the rows that are wanted of it."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 100 == 0, "de").otherwise("en").alias("lang"),
        F.xxhash64("id").alias("at"))
    drawn = {r.lang: r["count"] for r in langid.drawn_rows(rows, 400).groupBy("lang").count().collect()}
    assert drawn["de"] == 300 and 700 < drawn["en"] < 900
    sample = langid.first_of_each(langid.drawn_rows(rows, 400), 400)
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"de": 300, "en": 400}


def test_long_texts_are_read_whole(monkeypatch):
    text = "Der Text ist lang. " * 2000
    whole = langid.features(text + "ñ")
    assert whole is not None and not np.array_equal(whole, langid.features(text))
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert np.allclose(langid.features(text + "ñ"), whole, atol=0.02)


def auc(labels, scores):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    positive = labels.sum()
    return (ranks[labels == 1].sum() - positive * (positive - 1) / 2) / (
        positive * (len(labels) - positive)
    )


def test_toxicity_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op8_toxicity"](spark, folder).toPandas()
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda d: remainder(d, 5) == 0)).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    toxic, scores = held.toxic.to_numpy(), held.score.to_numpy()
    assert auc(toxic, scores) > 0.95
    assert held.predicted[toxic == 1].mean() > 0.8
    assert held.predicted[toxic == 0].mean() < 0.02


def test_toxicity_without_enough_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.rated(odd_docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1), (1, 0), (8, None), (None, 1)], "doc_id bigint, toxic int")
    scores = [r.score for r in toxicity.rated(odd_docs, some).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.rated(no_docs, some).count() == 0


def test_features():
    lexicon = {"rotten": 2.0}
    clean = dict(zip(toxicity.FEATURES, toxicity.described("A calm text about the sea.", lexicon)))
    rude = dict(zip(toxicity.FEATURES, toxicity.described("YOU are a r0tten idiot!!!", lexicon)))
    assert clean["hits"] == clean["insults"] == clean["obfuscated"] == 0
    assert rude["insults"] > 0 and rude["near"] > 0 and rude["obfuscated"] > 0
    assert rude["capitals"] > 0 and rude["exclamations"] > 0
    assert toxicity.described(None, lexicon) == [0.0] * len(toxicity.FEATURES)
