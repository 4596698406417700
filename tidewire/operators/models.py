"""Topic, embedding and prediction models on MLlib."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import LDA, KMeans, LDAModel, LocalLDAModel
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TopicModel:
    """Topics of token lists; fitted, applied, stored and loaded like any estimator."""

    k: int = 8
    iterations: int = 20
    seed: int = 42
    min_df: float = 3
    max_df: float = 0.85
    size: int = 5000
    counter: CountVectorizerModel | None = field(default=None, repr=False)
    model: LDAModel | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.k < 2 or self.iterations < 1 or self.size < 1 or self.min_df <= 0 or self.max_df <= 0:
            raise ValueError("topics from two on, and positive iterations, sizes and frequencies")

    def fit(self, docs: DataFrame, tokens: str) -> TopicModel:
        self.counter = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=self.size, minDF=self.min_df, maxDF=self.max_df).fit(docs)
        counted = self.counter.transform(docs)
        self.model = LDA(k=self.k, maxIter=self.iterations, seed=self.seed, optimizer="online", featuresCol="features", topicDistributionCol="topic").fit(counted)
        return self

    def _fitted(self) -> tuple[CountVectorizerModel, LDAModel]:
        if self.counter is None or self.model is None:
            raise ValueError("not fitted")
        return self.counter, self.model

    def transform(self, docs: DataFrame, key: str) -> DataFrame:
        """``key, shares, dominant_topic, confidence``; a document without a known word has no topic (-1)."""
        counter, model = self._fitted()
        counted = counter.transform(docs)
        empty = F.size(F.filter(vector_to_array("features"), lambda x: x > 0)) == 0
        share = F.when(empty, F.array_repeat(F.lit(0.0), self.k)).otherwise(vector_to_array("topic"))
        out, best = model.transform(counted).select(key, share.alias("shares")), F.array_max("shares")
        return out.select(key, "shares", F.when(best > 0, F.array_position("shares", best).cast("int")).otherwise(-1).alias("dominant_topic"), best.alias("confidence"))

    def terms(self, n: int = 10) -> DataFrame:
        """``topic, rank, term`` of the top terms of each topic."""
        counter, model = self._fitted()
        words = F.array(*[F.lit(w) for w in counter.vocabulary])
        return model.describeTopics(n).select("topic", F.posexplode("termIndices").alias("rank", "i")).select("topic", "rank", F.element_at(words, F.col("i") + 1).alias("term"))

    def save(self, folder: str) -> None:
        counter, model = self._fitted()
        counter.write().overwrite().save(f"{folder}/counter")
        model.write().overwrite().save(f"{folder}/topics")

    @classmethod
    def load(cls, folder: str) -> TopicModel:
        counter, model = CountVectorizerModel.load(f"{folder}/counter"), LocalLDAModel.load(f"{folder}/topics")
        return cls(k=model.getK(), counter=counter, model=model)


def topics(docs: DataFrame, key: str, tokens: str, k: int = 8, iterations: int = 20, seed: int = 42, min_df: float = 3, max_df: float = 0.85, size: int = 5000, fit_on: str = "true") -> tuple[DataFrame, DataFrame]:
    """``(documents, terms)``: topic shares with the dominant one, and the top terms of each topic.

    Vocabulary and topics come from the rows of ``fit_on``; a document without a
    known word has no topic (-1).
    """
    model = TopicModel(k, iterations, seed, min_df, max_df, size).fit(docs.filter(fit_on), tokens)
    return model.transform(docs, key), model.terms()


def word_vectors(docs: DataFrame, tokens: str, dims: int = 100, window: int = 5, least: int = 2, seed: int = 42, iterations: int = 5, partitions: int = 4):
    """A skip-gram model; the vectors of its words are a table. With more ``partitions`` parts of the texts are trained by themselves and averaged after each iteration."""
    return Word2Vec(vectorSize=dims, windowSize=window, minCount=least, maxIter=iterations, numPartitions=partitions, seed=seed, inputCol=tokens, outputCol="vector").fit(docs)


def word_table(docs: DataFrame, tokens: str, dims: int = 100, least: int = 2, **options) -> DataFrame:
    """``term, vector`` of :func:`word_vectors`. The executors look the terms up in the model, so that the driver makes no rows of them."""
    model = word_vectors(docs, tokens, dims, least=least, **options)
    counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # A text of one word has the word's vector.
    return model.transform(counts.filter(F.col("n") >= least).select("term", F.array("term").alias(tokens))).select("term", vector_to_array("vector").alias("vector"))


def reduced(df: DataFrame, vector: str, k: int, fit_on: str = "true") -> DataFrame:
    """Standardised principal components of an array column, fitted on the rows of ``fit_on``."""
    as_vector = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(as_vector.filter(fit_on))
    scaled = scaler.transform(as_vector)
    out = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled.filter(fit_on)).transform(scaled)
    return out.withColumn("components", vector_to_array("_p")).drop("_v", "_s", "_p")


def clusters(df: DataFrame, vector: str, k: int = 4, seed: int = 0) -> DataFrame:
    """Adds ``cluster``."""
    as_vector = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(as_vector).transform(as_vector).drop("_v")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def three_class(df: DataFrame, features: list[str], label: str, labels: tuple[str, ...], split: str = "split", seed: int = 42) -> DataFrame:
    """Adds class probabilities and the prediction of a random forest with balanced weights, fitted on train."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    rows = _assembled(df.filter(F.col(label).isNotNull()), features).withColumn("_y", index.cast("double"))
    n = rows.filter(F.col(split) == "train").groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    weighted = rows.join(F.broadcast(n), "_y", "left").crossJoin(F.broadcast(total)).withColumn("_w", F.coalesce(F.col("_t") / (len(labels) * F.col("_n")), F.lit(1.0)))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=50, maxDepth=3, seed=seed).fit(weighted.filter(F.col(split) == "train"))
    out = model.transform(weighted).withColumn("probabilities", vector_to_array("probability"))
    return out.withColumn("y_pred", F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int"))).drop("_x", "_y", "_n", "_t", "_w", "rawPrediction", "probability", "prediction")


def boosted_probabilities(df: DataFrame, features: list[str], label: str, labels: tuple[str, ...], split: str = "split", rounds: int = 20, seed: int = 42) -> DataFrame:
    """Adds ``probabilities`` of one boosted model per class against the rest, stopped on val and normalised."""
    rows = _assembled(df.filter(F.col(label).isNotNull()), features)
    columns = []
    for i, name in enumerate(labels):
        fit = rows.filter(F.col(split).isin("train", "val")).withColumn("_y", (F.col(label) == name).cast("double")).withColumn("_val", F.col(split) == "val")
        model = GBTClassifier(featuresCol="_x", labelCol="_y", validationIndicatorCol="_val", maxIter=rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(fit)
        rows = model.transform(rows).withColumn(f"_c{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        columns.append(f"_c{i}")
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return rows.withColumn("probabilities", F.array(*[F.col(c) / total for c in columns])).drop("_x", *columns)


def boosted_delta(df: DataFrame, features: list[str], delta: str, today: str, split: str = "split", rounds: int = 20, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Adds ``y_pred``: today's value and the predicted change; the second value is the importance of each feature."""
    rows = _assembled(df.filter(F.col(delta).isNotNull()), features).withColumn("_val", F.col(split) == "val")
    model = GBTRegressor(featuresCol="_x", labelCol=delta, validationIndicatorCol="_val", maxIter=rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed, predictionCol="_d").fit(rows.filter(F.col(split).isin("train", "val")))
    out = model.transform(rows).withColumn("y_pred", F.col(today) + F.col("_d")).drop("_x", "_val", "_d")
    return out, dict(zip(features, map(float, model.featureImportances.toArray()), strict=True))


def columns_of(df: DataFrame, prefix: str) -> list[str]:
    """Columns of a prefix with a numeric suffix, in order of the number."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def choose_topics(docs: DataFrame, key: str, tokens: str, candidates: tuple[int, ...] = (8, 10, 12, 15), fit_on: str = "true", top: int = 10, **options) -> tuple[int, DataFrame]:
    """The number of topics with the highest UMass coherence, the smallest of equal ones, and ``k, coherence`` of every candidate."""
    from tidewire.operators.features import coherence

    doc_terms = docs.filter(fit_on).select(F.col(key).alias("id"), F.explode(tokens).alias("term")).distinct()
    out = None
    for k in candidates:
        _, terms = topics(docs, key, tokens, k=k, fit_on=fit_on, **options)
        one = coherence(doc_terms, terms.filter(F.col("rank") < top)).select(F.lit(k).alias("k"), "coherence")
        out = one if out is None else out.unionByName(one)
    scored = docs.sparkSession.createDataFrame(out.collect(), out.schema)
    best = scored.orderBy(F.desc_nulls_last("coherence"), "k").first()
    return best["k"], scored


def truncated_svd(weights: DataFrame, key: str, k: int = 50, fit_on: str = "true") -> tuple[DataFrame, DataFrame]:
    """``(documents, values)`` of the uncentred decomposition of ``weights (key, term, w)``.

    ``documents (key, svd)`` has the first ``min(k, terms - 1)`` coordinates of
    each key that has a term, ``values (i, value)`` the singular values; both
    are fitted on the rows of ``fit_on``. The vocabulary is bounded by the caller.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.sql import Window

    spark = weights.sparkSession
    terms = weights.filter(fit_on).select("term").distinct().withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)
    size = terms.count()
    k = min(k, size - 1)
    if k < 1:
        return weights.select(key, F.array().cast("array<double>").alias("svd")).limit(0), spark.createDataFrame([], "i int, value double")
    placed = weights.join(terms, "term")
    rows = placed.filter(fit_on).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v")).select("v").rdd.map(lambda r: Vectors.sparse(size, [(x["i"], x["w"]) for x in r["v"]]))
    found = RowMatrix(rows, numCols=size).computeSVD(k)
    axes = found.V.toArray()
    # Axes have no sign of their own: the largest coordinate is made positive.
    axes = axes * [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in axes.T]
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(axes)], "i int, axis array<double>")
    each = placed.join(F.broadcast(table), "i").select(key, "w", F.posexplode("axis").alias("j", "x")).groupBy(key, "j").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    out = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("svd"))
    return out, spark.createDataFrame([(i, float(x)) for i, x in enumerate(found.s)], "i int, value double")


def widened(df: DataFrame, vector: str, prefix: str, dims: int, first: int = 1) -> DataFrame:
    """An array column as numbered columns; zeros for null."""
    return df.select(*[c for c in df.columns if c != vector], *[F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).cast("double").alias(f"{prefix}{i + first}") for i in range(dims)])


#: Columns of the series and of the lexicon scores that models use.
SERIES_FEATURES = ("log_return", "ret_lag1", "ret_lag2", "ret_std5")


def feature_group(df: DataFrame, group: str, series: tuple[str, ...] = SERIES_FEATURES) -> list[str]:
    """Columns of a feature group: ``none, basic, embedding, both``; an error if it needs columns that the table lacks."""
    lexicon = [c for c in df.columns if c.startswith(("valence_", "lm_")) or c in ("n_articles", "no_news")]
    basic, embedded = lexicon + columns_of(df, "tfidf_svd_"), columns_of(df, "emb_")
    if group not in ("none", "basic", "embedding", "both"):
        raise ValueError("group is none, basic, embedding or both")
    if group in ("embedding", "both") and not embedded:
        raise ValueError("the table has no emb_ columns")
    return [*series, *({"none": [], "basic": basic, "embedding": embedded, "both": basic + embedded}[group])]


def early_fusion(df: DataFrame, group: str, label: str, labels: tuple[str, ...], delta: str, today: str, rounds: int = 20, boosted: bool = False) -> DataFrame:
    """``y_pred_clf, y_pred_reg`` of one model of each task over the series and a group of text columns, fitted on train."""
    columns = feature_group(df, group)
    rows = df.dropna(subset=[*columns, label, delta])
    if boosted:
        best = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
        clf = boosted_probabilities(rows, columns, label, labels, rounds=rounds).withColumn("y_pred", best)
    else:
        clf = three_class(rows, columns, label, labels)
    reg, _ = boosted_delta(clf.withColumnRenamed("y_pred", "y_pred_clf"), columns, delta, today, rounds=rounds)
    return reg.withColumnRenamed("y_pred", "y_pred_reg")


def ablation(df: DataFrame, variants: dict[str, list[str]], label: str, labels: tuple[str, ...], split: str = "split") -> DataFrame:
    """``variant, split, features, accuracy, macro_f1`` of the same forest over several lists of columns."""
    from tidewire.operators.metrics import classification, confusion

    out = None
    for name, columns in variants.items():
        rows = three_class(df.dropna(subset=columns), columns, label, labels, split).filter(F.col(split) != "train")
        scores = classification(confusion(rows, label, "y_pred", labels, (split,)), (split,)).select(F.lit(name).alias("variant"), split, F.lit(len(columns)).alias("features"), "accuracy", "macro_f1")
        out = scores if out is None else out.unionByName(scores)
    return out


def categories(df: DataFrame, first: str, second: str, least_first: float = 0.15, least_second: float = 0.15) -> DataFrame:
    """Adds ``category``: 1 if both scores reach their thresholds, 2 the first alone, 3 the second alone, 4 neither."""
    a, b = F.col(first) >= least_first, F.col(second) >= least_second
    return df.withColumn("category", F.when(a & b, 1).when(a, 2).when(b, 3).otherwise(4))


def encoded(df: DataFrame, text: str, make_predict, dims: int, batch: int = 8) -> DataFrame:
    """Adds ``embedding`` by a model that is loaded once per worker and given batches of texts.

    ``make_predict()`` returns a function from an array of texts to a
    two-dimensional array; any encoder fits.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return df.withColumn("embedding", predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch)(F.coalesce(text, F.lit(""))))


def masked_mean(states, mask):
    """Mean of token states where the mask is set; a text without tokens has zeros."""
    weights = mask[..., None].astype(states.dtype)
    return (states * weights).sum(axis=1) / weights.sum(axis=1).clip(min=1e-9)
