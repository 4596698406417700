"""Static word embeddings behind one interface: skip-gram, subword skip-gram and looked-up vectors.

Each is fitted on token lists of the train rows and pools the vectors of a
group's tokens; ``make_embedding(name)`` finds them by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import character_grams, fnv1a
from tidewire.operators import features, models
from tidewire.runtime import cut, small


def _long(vectors: DataFrame) -> DataFrame:
    """``term, i, x`` of ``term, vector``."""
    return vectors.select("term", F.posexplode("vector").alias("i", "x"))


@dataclass
class _Pooled:
    """Pools the vectors of a group's tokens; a group without known tokens has zeros."""

    dims: int = 100
    vectors: DataFrame | None = field(default=None, repr=False)

    def save(self, folder: str) -> None:
        """Store the vectors as a table."""
        if self.vectors is None:
            raise ValueError("not fitted")
        self.vectors.write.mode("overwrite").parquet(folder)

    def load(self, spark: SparkSession, folder: str):
        """Take stored vectors instead of fitting."""
        self.vectors = spark.read.parquet(folder)
        return self

    def vocabulary(self, docs: DataFrame, tokens: str) -> DataFrame:
        """``term, vector`` of the distinct tokens that have a vector."""
        if self.vectors is None:
            raise ValueError("not fitted")
        terms = docs.select(F.explode(tokens).alias("term")).distinct()
        return self.vectors.join(terms, "term", "left_semi")

    def transform(self, docs: DataFrame, by: str, tokens: str) -> DataFrame:
        """``by, vector`` of every group of ``docs``."""
        long = features.pooled_by_token(docs, _long(self.vocabulary(docs, tokens)), by, tokens)
        return features.as_vectors(features.zero_filled(long, docs, by, self.dims), by)


@dataclass
class Word2Vec(_Pooled):
    """Skip-gram with hierarchical softmax."""

    window: int = 5
    least: int = 2
    iterations: int = 5
    seed: int = 42
    partitions: int = 4

    def fit(self, docs: DataFrame, tokens: str) -> Word2Vec:
        model = models.word_vectors(docs, tokens, self.dims, self.window, self.least, self.seed, self.iterations, self.partitions)
        self.vectors = cut(model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vector")), "word2vec")
        return self


@dataclass
class Glove(_Pooled):
    """Vectors that were trained elsewhere, as a table ``term, vector``; unknown tokens don't count."""

    source: DataFrame | None = field(default=None, repr=False)

    def fit(self, docs: DataFrame, tokens: str) -> Glove:
        if self.source is None:
            raise ValueError("give the table of vectors")
        self.vectors = self.source.join(docs.select(F.explode(tokens).alias("term")).distinct(), "term", "left_semi")
        return self


def _train_part(buckets: int, dims: int, start: np.ndarray, context: np.ndarray, names: list[str], noise: np.ndarray, window: int, negatives: int, rate: float, seed: int):
    """One pass of subword skip-gram with negative sampling over the token lists of a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        inner, outer = start.copy(), context.copy()
        moved, number, cumulated = np.zeros(buckets, bool), {w: i for i, w in enumerate(names)}, np.cumsum(noise)
        for batch in batches:
            for words, grams in zip(batch["words"], batch["grams"], strict=True):
                places = [(number[w], np.asarray(g)) for w, g in zip(words, grams, strict=True) if w in number]
                for at, (_, own) in enumerate(places):
                    around = [places[j][0] for j in range(max(0, at - window), min(len(places), at + window + 1)) if j != at]
                    if not around:
                        continue
                    wrong = np.searchsorted(cumulated, rng.random(len(around) * negatives))
                    targets = np.concatenate([around, wrong])
                    truth = np.concatenate([np.ones(len(around)), np.zeros(len(wrong))])
                    word = inner[own].mean(axis=0)
                    error = (truth - 1 / (1 + np.exp(-np.clip(outer[targets] @ word, -30, 30)))) * rate
                    step = error @ outer[targets]
                    np.add.at(outer, targets, error[:, None] * word)
                    np.add.at(inner, own, step / len(own))
                    moved[own] = True
        for kind, table, rows in (("inner", inner, np.flatnonzero(moved)), ("outer", outer, np.arange(len(outer)))):
            if len(rows):
                yield pd.DataFrame({"kind": kind, "row": rows, "vector": list(table[rows].astype(np.float32))})

    return run


@dataclass
class FastText(_Pooled):
    """Skip-gram whose words are the mean of hashed substrings, so that every word has a vector.

    Each round trains the parts of the texts by themselves and averages their
    tables. The tables are bounded by ``buckets`` and ``most`` and pass through
    the driver.
    """

    buckets: int = 50_000
    window: int = 5
    least: int = 2
    rounds: int = 5
    negatives: int = 5
    rate: float = 0.025
    seed: int = 42
    most: int = 100_000
    parts: int = 4
    table: np.ndarray | None = field(default=None, repr=False)

    def _grams(self, terms: DataFrame) -> DataFrame:
        grams = F.array_distinct(F.transform(character_grams(F.col("term")), lambda g: fnv1a(g, self.buckets)))
        return terms.withColumn("grams", grams)

    def fit(self, docs: DataFrame, tokens: str) -> FastText:
        counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= self.least)
        chosen = cut(self._grams(counts.orderBy(F.desc("n"), "term").limit(self.most)), "terms")
        # At most ``most`` words.
        listed = chosen.orderBy(F.desc("n"), "term").select("term", "n").collect()
        names = [r[0] for r in listed]
        noise = np.array([r[1] for r in listed], float) ** 0.75
        noise = noise / max(noise.sum(), 1e-300)
        rng = np.random.default_rng(self.seed)
        inner, outer = (rng.random((self.buckets, self.dims)) - 0.5) / self.dims, np.zeros((len(names), self.dims))
        placed = docs.select(F.monotonically_increasing_id().alias("_d"), F.posexplode(tokens).alias("_p", "term")).join(small(chosen.select("term", "grams"), self.most), "term")
        texts = placed.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("_p", "term", "grams"))).alias("_w"))
        texts = cut(texts.select(F.transform("_w", lambda x: x["term"]).alias("words"), F.transform("_w", lambda x: x["grams"]).alias("grams")).repartition(self.parts), "texts")
        for i in range(self.rounds if names else 0):
            rate = self.rate * max(1 - i / self.rounds, 0.004)
            run = _train_part(self.buckets, self.dims, inner, outer, names, noise, self.window, self.negatives, rate, self.seed + i)
            parts = texts.mapInPandas(run, "kind string, row int, vector array<float>").select("kind", "row", F.posexplode("vector").alias("j", "x"))
            means = parts.groupBy("kind", "row", "j").agg(F.avg("x").alias("x")).groupBy("kind", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("v"))
            for r in means.toLocalIterator():
                (inner if r["kind"] == "inner" else outer)[r["row"]] = r["v"]
        self.table = inner
        return self

    def save(self, folder: str) -> None:
        """Store the vectors of the buckets as a table."""
        if self.table is None:
            raise ValueError("not fitted")
        self._rows(SparkSession.active()).write.mode("overwrite").parquet(folder)

    def load(self, spark: SparkSession, folder: str) -> FastText:
        """Take stored buckets, at most ``buckets`` rows, instead of training."""
        rows = spark.read.parquet(folder).orderBy("b").collect()
        self.table, self.buckets, self.dims = np.array([r["v"] for r in rows]), len(rows), len(rows[0]["v"])
        return self

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, v) for i, v in enumerate(self.table.tolist())], "b bigint, v array<double>")

    def vocabulary(self, docs: DataFrame, tokens: str) -> DataFrame:
        if self.table is None:
            raise ValueError("not fitted")
        rows = self._rows(docs.sparkSession)
        terms = self._grams(docs.select(F.explode(tokens).alias("term")).distinct())
        each = terms.select("term", F.explode("grams").alias("b")).join(rows, "b").select("term", F.posexplode("v").alias("i", "x"))
        return features.as_vectors(each.groupBy("term", "i").agg(F.avg("x").alias("x")), "term")


EMBEDDINGS = {"word2vec": Word2Vec, "fasttext": FastText, "glove": Glove}


def make_embedding(name: str, **options):
    """An embedding by its name, blanks and case aside."""
    found = EMBEDDINGS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"{name!r} is none of {', '.join(sorted(EMBEDDINGS))}")
    return found(**options)


def embedding_features(name: str, docs: DataFrame, by: str, tokens: str, split: str = "split", **options) -> DataFrame:
    """Fit on train, pool every group: ``by, vector``."""
    return make_embedding(name, **options).fit(docs.filter(F.col(split) == "train"), tokens).transform(docs, by, tokens)
