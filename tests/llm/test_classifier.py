"""Quality scores: held-out accuracy, vectors by plain loops, labels that must not be used, odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echocache.llm import classifier, queries

FOLDER = "/root/testdata/sf0.01"


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


def test_held_out_accuracy_and_contract(spark):
    got = queries.op12_quality_classifier(spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    told = got.merge(labels, on="doc_id")
    told = told[told.held_out]
    assert len(told) > 80 and auc(told.score.to_numpy(), told.quality.to_numpy()) >= 0.95
    assert told.predicted[told.quality == 1].mean() >= 0.95 and told.predicted[told.quality == 0].mean() <= 0.15
    # Probabilities: near the share of good documents on the average, and better than that share for all.
    share = told.quality.mean()
    loss = -np.where(told.quality == 1, np.log(told.score + 1e-9), np.log(1 - told.score + 1e-9)).mean()
    assert abs(told.score.mean() - share) < 0.08 and loss < 0.5 * -(share * np.log(share) + (1 - share) * np.log(1 - share))


def test_held_out_labels_are_never_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    hidden = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        {r.doc_id: r.score for r in classifier.score(docs, classifier.fit(docs, x)).collect()} for x in (labels, hidden)
    ]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 100


def slot(word):
    return zlib.crc32(word.encode()) % classifier.SLOTS


def by_hand(texts):
    places, signs = classifier.index_vectors()
    table = np.zeros((classifier.SLOTS, classifier.WIDTH))
    for text in texts:
        words = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
        for i, w in enumerate(words):
            for j in range(max(0, i - classifier.WINDOW), min(len(words), i + classifier.WINDOW + 1)):
                if j != i:
                    np.add.at(table[slot(w)], places[slot(words[j])], signs[slot(words[j])])
    used = np.abs(table).sum(axis=1) > 0
    unit = table[used] / np.linalg.norm(table[used], axis=1, keepdims=True)
    unit -= unit.mean(axis=0)
    table[used] = unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-9)
    return table


TEXTS = ["a b c, d!! 42 e_f", None, "", "one", "one two", "x y " * 300 + "z", "日本 语 ünï 🙂🙂 \t\n", "b a b a"]


@pytest.mark.parametrize("block, at_once", [(1 << 17, 1 << 20), (7, 10), (1, 0), (50, 1 << 20)])
def test_word_vectors_by_plain_loops(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(classifier, "BLOCK", block)
    monkeypatch.setattr(classifier, "AT_ONCE", at_once)
    monkeypatch.setattr(classifier, "REMEMBERED", 3)
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string").repartition(3)
    table = classifier.word_vectors(df)
    assert np.allclose(table, by_hand(TEXTS), atol=1e-5)
    slots = classifier._Slots()
    for text in TEXTS:
        words = [slot(w) for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")]
        got = classifier.pooled(slots.of(text), table)
        if not words:
            assert not got.any()
            continue
        vectors, w = table[words], classifier.WIDTH
        own = table[sorted(set(words))]
        assert np.allclose(got[:w], vectors.mean(axis=0), atol=1e-5) and np.allclose(got[w : 2 * w], own.mean(axis=0), atol=1e-5)
        assert np.allclose(got[2 * w : -2], own.std(axis=0), atol=1e-5)
        assert np.allclose(got[-2:], [len(set(words)) / len(words), np.log1p(len(words))])


ROWS = [(1, "good text here"), (2, None), (3, ""), (None, "nobody's text"), (5, "good text here"), (5, "good text here"), (6, "w " * 200_000)]


def test_odd_rows_labels_and_names(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "numbers", "label", "draw", "sums")})
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (3, 0), (None, 1), (99, 1), (5, 1), (6, 0)], "doc_id long, quality int"
    )
    table, net = classifier.fit(df, labels)
    got = classifier.score(df, (table, net)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and got[0].label == "x"
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    for none in (labels.where("false"), labels.where("quality IS NULL"), labels.where("doc_id = 99")):
        model = classifier.fit(df, none)
        assert model[1] is None and {r.score for r in classifier.score(df, model).collect()} == {0.5}
    empty = df.where("false")
    assert classifier.score(empty, classifier.fit(empty, labels)).count() == 0
    with pytest.raises(ValueError, match="Label"):
        classifier.score(df, (table, net), out="Label")


def test_labelled_documents_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda x, y: seen.append(len(x)))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    classifier.fit(df, labels, max_labelled=400)
    classifier.fit(df.union(df), labels, max_labelled=100)
    classifier.fit(df, labels)
    assert 250 <= seen[0] <= 400 and seen[1] == 100 and 2000 < seen[2] < 2500


def test_temperature_and_training():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single layer can tell
    net = classifier.train(x, y, rounds=80)
    fresh = rng.normal(size=(400, 5))
    assert ((net.scores(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.85
    noisy = classifier.train(x, rng.integers(0, 2, 4000).astype(float))
    assert noisy.temperature > 1.5 and net.temperature < noisy.temperature
