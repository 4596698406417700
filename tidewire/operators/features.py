"""Terms, lexicon scores, weights and pooled vectors as long tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, term, tf`` of an array column."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``term, df, total`` of term counts."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, least: int = 1, share: float = 1.0, size: int | None = None) -> DataFrame:
    """``term, df, total`` within ``least`` documents and a ``share`` of ``n_docs (n)``; the ``size`` most frequent terms, ties by name."""
    terms = document_frequency(counts).crossJoin(F.broadcast(n_docs)).filter((F.col("df") >= least) & (F.col("df") <= share * F.col("n"))).drop("n")
    return terms.orderBy(F.desc("total"), "term").limit(size) if size else terms


def tfidf(counts: DataFrame, terms: DataFrame, n_docs: DataFrame, key: str) -> DataFrame:
    """``key, term, w``: sublinear term frequency, smoothed inverse document frequency, unit length."""
    raw = counts.join(terms.select("term", "df"), "term").crossJoin(F.broadcast(n_docs))
    raw = raw.select(key, "term", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))


def _term_counts(bags: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of bags of words; and the bag, the place among the distinct words and the count of each word of each bag."""
    lists = pc.split_pattern(bags, " ")
    words, of = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    codes, size = words.indices.to_numpy(zero_copy_only=False), max(len(words.dictionary), 1)
    keys, tf = np.unique(of.astype(np.int64) * size + codes, return_counts=True)
    full = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[keys % size] if len(keys) else np.zeros(0, bool)
    return words.dictionary, (keys // size)[full], (keys % size)[full], tf[full]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, _, code, tf = _term_counts(batch["bag"])
        df, total = np.bincount(code, minlength=len(words)), np.bincount(code, tf, len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([words.filter(pa.array(df > 0)), pa.array(df[df > 0]), pa.array(total[df > 0])], ["term", "df", "total"])


def bag_frequency(bags: DataFrame) -> DataFrame:
    """``term, df, total`` of ``bags (id, bag)``, words with blanks between them; one bag for each key."""
    parts = bags.select("bag").mapInArrow(_frequencies, "term string, df bigint, total bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def bag_vectors(bags: DataFrame, terms: list[tuple[str, int]], n_docs: int) -> DataFrame:
    """``id, t, w`` of ``bags (id, bag)``: the vectors of :func:`tfidf` with terms by their place in ``terms (term, df)``, ascending."""
    names, idf = [term for term, _ in terms], np.array([np.log((1 + n_docs) / (1 + df)) + 1 for _, df in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in batches:
            words, of, code, tf = _term_counts(batch["bag"])
            places = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = places[code] >= 0
            of, t, tf = of[found], places[code[found]], tf[found]
            order = np.lexsort((t, of))
            of, t, tf = of[order], t[order], tf[order]
            w = (1 + np.log(tf)) * idf[t]
            w = w / np.sqrt(np.bincount(of, w * w, batch.num_rows))[of]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(offsets, pa.array(t)), pa.ListArray.from_arrays(offsets, pa.array(w))], ["id", "t", "w"])

    return bags.select("id", "bag").mapInArrow(run, f"id {bags.schema['id'].dataType.simpleString()}, t array<bigint>, w array<double>")


def lexicon_scores(docs: DataFrame, lexicon: DataFrame, key: str, tokens: str, words: str, categories: tuple[str, ...]) -> DataFrame:
    """Share of words in each category of ``lexicon (word, category)``, over at least one word."""
    found = docs.select(key, F.explode(tokens).alias("word")).join(lexicon, "word").groupBy(key).pivot("category", list(categories)).count()
    scored = docs.select(key, words).join(found, key, "left")
    return scored.select(key, *[(F.coalesce(c, F.lit(0)) / F.greatest(F.col(words), F.lit(1))).alias(c) for c in categories])


def valence(docs: DataFrame, lexicon: DataFrame, key: str, tokens: str, alpha: float = 15.0) -> DataFrame:
    """Summed valence of ``lexicon (word, valence)``, squashed to -1..1; zero without a known word."""
    summed = docs.select(key, F.explode(tokens).alias("word")).join(lexicon, "word").groupBy(key).agg(F.sum("valence").alias("s"))
    return docs.select(key).join(summed, key, "left").select(key, F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + alpha), F.lit(0.0)).alias("compound"))


def sentence_valence(docs: DataFrame, lexicon: DataFrame, key: str, sentences: str, alpha: float = 15.0) -> DataFrame:
    """``key, mean, neg_share``: mean squashed valence of an array of sentences and the share at or below -0.05; zeros without sentences."""
    each = docs.select(key, F.posexplode(sentences).alias("_i", "_s"))
    words = each.select(key, "_i", F.explode(F.regexp_extract_all(F.lower("_s"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).join(lexicon, "word")
    summed = words.groupBy(key, "_i").agg(F.sum("valence").alias("_v"))
    squashed = F.coalesce(F.col("_v") / F.sqrt(F.col("_v") * F.col("_v") + alpha), F.lit(0.0))
    scored = each.select(key, "_i").join(summed, [key, "_i"], "left").withColumn("_c", squashed)
    per = scored.groupBy(key).agg(F.avg("_c").alias("mean"), F.avg((F.col("_c") <= -0.05).cast("int")).alias("neg_share"))
    return docs.select(key).join(per, key, "left").fillna(0.0, ["mean", "neg_share"])


def token_coverage(docs: DataFrame, terms: DataFrame, by: str, tokens: str) -> DataFrame:
    """Tokens and known tokens per group."""
    each = docs.select(by, F.explode(tokens).alias("term")).join(terms.select("term", F.lit(1).alias("known")), "term", "left")
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("tokens"), F.count("known").alias("known")).withColumn("coverage", F.try_divide("known", "tokens"))


def pooled_by_token(docs: DataFrame, vectors: DataFrame, by: str, tokens: str) -> DataFrame:
    """Mean of ``vectors (term, i, x)`` over all known tokens of a group: ``by, i, x``."""
    # Each term of a group meets its vector once, however often it occurs.
    counts = docs.select(by, F.explode(tokens).alias("term")).groupBy(by, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.join(vectors, "term").groupBy(by, "i").agg((F.sum(F.col("x") * F.col("tf")) / F.sum("tf")).alias("x"))


def _pooled_sums(dims: int, most: int):
    """``by, n, sums`` of counted vectors: what a task has of each group, passed on once ``most`` groups are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        n, sums = np.zeros(0), np.zeros((0, dims))

        def held() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * dims, pa.int32()), pa.array(sums[: len(place)].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(list(place), kind), pa.array(n[: len(place)]), lists], ["by", "n", "sums"])

        for batch in batches:
            kind, codes = batch["by"].type, batch["by"].dictionary_encode(null_encoding="encode")
            groups, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            tf, x = batch["tf"].to_numpy().astype(float), batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            at = np.array([place.setdefault(g, len(place)) for g in groups], int)
            if len(place) > len(n):
                n, sums = np.concatenate([n, np.zeros(2 * len(place) - len(n))]), np.concatenate([sums, np.zeros((2 * len(place) - len(sums), dims))])
            order = np.argsort(of, kind="stable")
            begins = np.flatnonzero(np.diff(of[order], prepend=-1))
            if len(begins):
                now = at[of[order][begins]]
                n[now] += np.add.reduceat(tf[order], begins)
                sums[now] += np.add.reduceat((x * tf[:, None])[order], begins)
            if len(place) > most:
                yield held()
                place, n, sums = {}, np.zeros(0), np.zeros((0, dims))
        if place:
            yield held()

    return run


def pooled_vectors(docs: DataFrame, vectors: DataFrame, by: str, tokens: str, dims: int, most: int = 20_000) -> DataFrame:
    """``by, vector``: mean of ``vectors (term, vector)`` of ``dims`` numbers over all known tokens of a group, summed in each task first."""
    counts = docs.select(F.col(by).alias("by"), F.explode(tokens).alias("term")).groupBy("by", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counts.join(vectors, "term").select("by", "tf", F.col("vector").cast("array<double>").alias("vector"))
    sums = known.mapInArrow(_pooled_sums(dims, most), f"by {docs.schema[by].dataType.simpleString()}, n double, sums array<double>")
    total = sums.select("by", "n", F.posexplode("sums").alias("i", "x")).groupBy("by", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return as_vectors(total, "by").withColumnRenamed("by", by)


def zero_filled(long: DataFrame, groups: DataFrame, by: str, dims: int) -> DataFrame:
    """``by, i, x`` of every group of ``groups (by)``, zeros for those that ``long`` doesn't have."""
    places = groups.select(by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    return places.join(long, [by, "i"], "left").select(by, "i", F.coalesce("x", F.lit(0.0)).alias("x"))


def shared_terms(vocabularies: list[DataFrame], size: int) -> DataFrame:
    """``term, total`` of the ``size`` most frequent terms that every one of ``vocabularies (term, total)`` has, by the first one's counts."""
    first, *rest = vocabularies
    for other in rest:
        first = first.join(other.select("term"), "term", "left_semi")
    return first.orderBy(F.desc("total"), "term").limit(size).select("term", "total")


def pooled(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean of an array column per group: ``by, i, x``."""
    return df.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def as_vectors(long: DataFrame, by: str) -> DataFrame:
    """``by, vector`` of ``by, i, x``; ordered by position."""
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))


def day_documents(df: DataFrame, day: str, order: str, text: str) -> DataFrame:
    """All texts of a day in a stated order, joined by blanks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda e: e["t"])
    return df.filter(F.col(text).isNotNull()).groupBy(day).agg(F.array_join(ordered, " ").alias("document"))


def topic_means(shares: DataFrame, topics: tuple[str, ...], split: str = "split", splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """``topic`` and a column per split: the mean share of each topic."""
    means = shares.groupBy(split).agg(*[F.avg(c).alias(c) for c in topics]).unpivot([split], list(topics), "topic", "share")
    return means.groupBy("topic").pivot(split, list(splits)).agg(F.max("share")).fillna(0.0)


def sigmoid(x, limit: float = 30.0):
    """Logistic function of a column, its argument clipped."""
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))))


def coherence(doc_terms: DataFrame, topics: DataFrame) -> DataFrame:
    """UMass coherence of ``topics (topic, rank, term)`` over ``doc_terms (id, term)``: mean over topics of the mean over pairs."""
    used = doc_terms.join(topics.select("term").distinct(), "term").select("id", "term").distinct()
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    a, b = topics.alias("a"), topics.alias("b")
    # A term of a higher rank comes later; it is the first of the pair, and the earlier one conditions it.
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") > F.col("b.rank"))).select(F.col("a.topic").alias("topic"), F.col("a.term").alias("later"), F.col("b.term").alias("earlier"))
    asked = pairs.select("later", "earlier").distinct()
    x, y = used.select("id", F.col("term").alias("later")), used.select("id", F.col("term").alias("earlier"))
    both = asked.join(x, "later").join(y, ["id", "earlier"]).groupBy("later", "earlier").agg(F.count(F.lit(1)).alias("both"))
    scored = pairs.join(both, ["later", "earlier"], "left").join(df.select(F.col("term").alias("later"), "df"), "later", "left")
    score = F.ln((F.coalesce("both", F.lit(0)) + 1) / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    return scored.groupBy("topic").agg(F.avg(score).alias("umass")).agg(F.avg("umass").alias("coherence"))


def daily_aggregate(df: DataFrame, day: str, score: str) -> DataFrame:
    """Count, mean, least and share of clearly negative scores per day."""
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("n_articles"), F.avg(score).alias("score_mean"), F.min(score).alias("score_min"),
        F.avg((F.col(score) <= -0.05).cast("int")).alias("neg_share"),
    )


def recency_weighted(df: DataFrame, day: str, hours: str, score: str, scale: float = 24.0) -> DataFrame:
    """Mean weighted by ``exp(-hours / scale)``."""
    weight = F.exp(-F.col(hours) / scale)
    return df.groupBy(day).agg((F.sum(weight * F.col(score)) / F.sum(weight)).alias("score_w"), F.avg(hours).alias("mean_hours"))
