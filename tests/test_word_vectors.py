"""Word vectors and their means, without rows on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from tidewire.operators import features, models
from tidewire.plans import registry

DOCS = [("a", ["x", "y", "x", "rare"]), ("a", ["y", "z"]), (None, ["z", "z", "x"]), ("b", ["rarer"]), ("c", [])]


def test_table_of_words_equals_the_models_own(spark):
    docs = spark.createDataFrame(DOCS * 3 + [("d", ["once"])], "day string, tokens array<string>").coalesce(1)
    want = {r["word"]: r["vector"].toArray() for r in models.word_vectors(docs, "tokens", 5, partitions=1).getVectors().collect()}
    got = {r["term"]: r["vector"] for r in models.word_table(docs, "tokens", 5, partitions=1).collect()}
    assert set(got) == set(want) == {"x", "y", "z", "rare", "rarer"}
    assert all(np.allclose(got[w], want[w]) for w in want)


def test_pooled_vectors_equal_the_mean_of_tokens(spark):
    docs = spark.createDataFrame(DOCS, "day string, tokens array<string>")
    known = {"x": [1.0, 2.0], "y": [0.5, -1.0], "z": [4.0, 0.0]}
    vectors = spark.createDataFrame(list(known.items()), "term string, vector array<double>")
    for most in (20_000, 1):
        got = {r["day"]: r["vector"] for r in features.pooled_vectors(docs, vectors, "day", "tokens", 2, most).collect()}
        assert set(got) == {"a", None}
        for day in got:
            found = [known[w] for d, words in DOCS if d == day for w in words if w in known]
            assert np.allclose(got[day], np.mean(found, axis=0)), (day, most)


def test_word2vec_pool_collects_no_vectors(spark, sf_dir, monkeypatch):
    def refuse(self):
        raise AssertionError("all vectors as rows of the driver")

    monkeypatch.setattr(Word2VecModel, "getVectors", refuse)
    out = registry.queries()["word2vec_pool"](spark, sf_dir)
    assert out.columns == ["day", "vector"] and out.filter(F.size("vector") != 100).count() == 0 and out.count() > 1
