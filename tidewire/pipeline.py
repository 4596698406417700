"""Entry points: each takes tables, runs one stage, and writes or returns its results.

Every stage is a function from DataFrames to DataFrames; ``run_pipeline`` joins
them, and ``main`` gives each a command. Results are Parquet folders, but for
the small tables that people read, which are CSV.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import contracts
from tidewire.functions import text as t
from tidewire.operators import articles, calendar, embeddings, features, joins, metrics, models, series
from tidewire.operators.series import LABELS
from tidewire.runtime import cut, temporary_cuts
from tidewire.sources import files

Tables = dict[str, DataFrame]


# --- rates


def preprocess_rates(raw: DataFrame, day: str = "tanggal", rate: str = "kurs_jisdor") -> Tables:
    """``rates (date, rate)`` in order of time, and ``rejected``, how many rows each rule dropped."""
    contracts.require_columns(raw, day, rate)
    return {"rates": series.clean_rates(raw, day, rate).orderBy("date"), "rejected": series.rejected_rates(raw, day, rate)}


def formulate_targets(rates: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Changes with tomorrow's label, rate and difference; days without a change or a tomorrow are dropped."""
    return series.changes(rates, threshold=threshold).dropna(subset=["target", "pct_change"])


def split_dataset(days: DataFrame, train: float = 0.8, val: float = 0.1, embargo: int = 1, folds: int = 10) -> Tables:
    """``split`` by position in time, ``spans`` of its parts and ``folds`` inside train."""
    split = series.chronological_split(days, train=train, val=val, embargo=embargo)
    contracts.require_chronological(split)
    spans = split.groupBy("split").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"))
    inner = series.expanding_folds(split.filter("split = 'train'").select("date"), folds=folds)
    return {"split": split, "spans": spans, "folds": inner}


def rate_charts(rates: DataFrame, events: DataFrame) -> Tables:
    """The frames behind the charts of rates: ``daily``, ``yearly``, and ``events (day, name)`` with their rate."""
    yearly = rates.groupBy(F.year("date").alias("year")).agg(F.bround(F.avg("rate"), 0).cast("bigint").alias("mean_rate"))
    overlay = F.broadcast(events).join(rates.withColumnRenamed("date", "day"), "day", "left")
    return {"daily": rates.orderBy("date"), "yearly": yearly.orderBy("year"), "events": overlay.dropna(subset=["rate"])}


def naive_baselines(split: DataFrame) -> Tables:
    """``comparison`` of persistence, majority and random walk per split, and the ``confusion`` cells of the first."""
    kept = series.persistence(split)
    cells = metrics.confusion(kept, "target", "prediction", LABELS, ("split",))
    most = metrics.confusion(series.majority(split), "target", "prediction", LABELS, ("split",))
    clf = {"persistence": metrics.classification(cells, ("split",)), "majority": metrics.classification(most, ("split",))}
    reg = {"random walk": metrics.regression(split, "rate_next", "rate", "rate", ("split",))}
    tagged = {k: v.withColumn("task", F.lit("clf")) for k, v in clf.items()} | {k: v.withColumn("task", F.lit("reg")) for k, v in reg.items()}
    return {"comparison": joins.tagged_union(tagged, "model"), "confusion": cells, "per_class": metrics.per_class(cells, ("split",))}


def score_predictions(predictions: DataFrame, digits: int = 4) -> DataFrame:
    """Metrics of both tasks for stored predictions, per model and split, with the skill against the random walk."""
    by = ("model", "split")
    clf = metrics.classification(metrics.confusion(predictions, "y_true_clf", "y_pred_clf", LABELS, by), by)
    reg = metrics.regression(predictions, "y_true_reg", "y_pred_reg", "kurs_today", by)
    walk = metrics.regression(predictions, "y_true_reg", "kurs_today", "kurs_today", by).select(*by, F.round("rmse", digits).alias("_walk"))
    reg = reg.join(walk, list(by)).withColumn("skill_vs_naive", metrics.skill(F.col("rmse"), F.col("_walk"))).drop("_walk")
    out = clf.join(reg, list(by))
    return out.select(*by, *[F.round(c, digits).alias(c) for c in out.columns if c not in by])


# --- news


def align_articles(df: DataFrame, days: DataFrame, holidays: DataFrame | None = None, day_of: str = "published_wib") -> DataFrame:
    """Adds ``trading_date`` by the calendar of ``days (date, split)`` and the ``split`` of that day."""
    first, last = days.agg(F.min("date"), F.date_add(F.max("date"), 14)).first()
    opens = calendar.trading_calendar(df.sparkSession, str(first), str(last), holidays)
    aligned = calendar.align(df, opens, F.col(day_of))
    return contracts.join_many_to_one(aligned.filter("trading_date is not null"), days.select(F.col("date").alias("trading_date"), "split"), ["trading_date"])


def news_stages(df: DataFrame, stage: str = "all", source: str = "html", least_first: float = 0.15, least_second: float = 0.15, clusters: int = 4, seed: int = 42, similar: float = 0.8) -> Tables:
    """``cleaning``, ``filtering`` and ``preprocessing`` of records, up to ``stage``.

    Records with a column ``source`` of pages are taken apart first. The filter
    keeps articles with a keyword, scores them by their share of keywords of
    two kinds, and gives a category by thresholds and a cluster.
    """
    if stage not in ("cleaning", "filtering", "preprocessing", "all"):
        raise ValueError("stage is cleaning, filtering, preprocessing or all")
    out: Tables = {}
    if source in df.columns:
        pages = files.extract_pages(df.withColumn("_id", F.monotonically_increasing_id()), "_id", source)
        pages = files.linked_articles(pages, "linked_data", "heading")
        df = pages.select(F.col("key").alias("record"), F.coalesce("headline", "title").alias("title"), F.coalesce("date_published", "published_at").alias("published_at"), F.coalesce("authors", "author").alias("author"), "heading", "body")
    have = {c: F.lit(None).cast("string") for c in ("title", "body", "discovery_title") if c not in df.columns}
    out["cleaning"] = df.withColumns(have) if have else df
    if stage == "cleaning":
        return out
    kept = articles.with_matches(out["cleaning"])
    whole = F.concat_ws(" ", "title", "body")
    share = lambda names: F.size(t.term_hits(whole, tuple(x for n in names for x in t.KEYWORD_GROUPS[n]))) / F.greatest(F.size("_hits"), F.lit(1))
    scored = kept.withColumn("_hits", t.term_hits(whole, t.keyword_terms())).withColumn("p_geopolitics", share(("conflict", "sanction", "diplomacy", "political_risk"))).withColumn("p_rate", share(("trade",))).drop("_hits")
    scored = models.categories(scored, "p_geopolitics", "p_rate", least_first, least_second)
    if scored.limit(clusters).count() >= clusters:
        scored = models.clusters(scored.withColumn("_v", F.array("p_geopolitics", "p_rate")), "_v", clusters, seed).drop("_v")
    out["filtering"] = scored
    if stage == "filtering":
        return out
    out["preprocessing"] = articles.preprocessed(scored, similar=similar)
    return out


def demo_pages(spark: SparkSession) -> DataFrame:
    """Three small pages: one on geopolitics with linked data and a repeated paragraph, one on the economy, one on sport."""
    linked = '{"@type": "NewsArticle", "headline": "Sanctions and war weigh on the rupiah", "author": {"name": "A. Writer"}, "datePublished": "2024-05-01"}'
    first = f'<html><head><title>Other title</title><script type="application/ld+json">{linked}</script></head><body><h2>Dollar firmer</h2><p>The war and new sanctions raise the threat to trade.</p><p>More at https://news.example/1 and desk@news.example today.</p><p>The war and new sanctions raise the threat to trade.</p></body></html>'
    second = "<html><head><title>Bank keeps its course</title></head><body><p>The bank reports larger reserves.</p><p>Markets are calm and exports grow.</p></body></html>"
    third = "<html><head><title>Late goal</title></head><body><p>The match ended in a draw after a late goal.</p></body></html>"
    return spark.createDataFrame([(i, page) for i, page in enumerate((first, second, third))], "record bigint, html string")


# --- models


def model_dataset(scores: DataFrame, days: DataFrame, weights: DataFrame | None = None, dims: int = 50, next_window: bool = True) -> DataFrame:
    """The wide table: series, daily scores, and coordinates of TF-IDF ``weights (day, term, w)`` fitted on train.

    ``scores`` has a day and the measures of each article.
    """
    wide = articles.daily_features(scores, days, "day", next_window)
    if weights is None:
        return wide
    spine = wide.select("news_date", "split")
    placed = cut(weights.join(spine, weights["day"] == spine["news_date"]).select("news_date", "split", "term", "w"), "weights")
    coordinates, _ = models.truncated_svd(placed.withColumn("_k", F.struct("news_date", "split")), "_k", dims, "_k.split = 'train'")
    k = len((coordinates.select("svd").first() or [[]])[0])
    columns = models.widened(coordinates.select("_k.news_date", "svd"), "svd", "tfidf_svd_", k)
    return wide.join(columns, "news_date", "left").fillna(0.0, [f"tfidf_svd_{i}" for i in range(1, k + 1)])


def _sunk(df: DataFrame, model: str) -> DataFrame:
    return files.predictions(df.select("date", "split", F.col("target").alias("y_true_clf"), F.col("y_pred_clf"), F.col("kurs_jisdor").alias("kurs_today"), F.col("kurs_besok").alias("y_true_reg"), F.col("y_pred_reg")).filter("split <> 'train'"), model)


def series_model(wide: DataFrame, rounds: int = 20) -> DataFrame:
    """Stored predictions of both tasks by the series alone."""
    return _sunk(models.early_fusion(wide, "none", "target", LABELS, "delta_besok", "kurs_jisdor", rounds), "series")


def text_model(wide: DataFrame, rounds: int = 20) -> DataFrame:
    """Stored predictions of both tasks by the text columns alone."""
    columns = [c for c in models.feature_group(wide, "basic") if c not in models.SERIES_FEATURES]
    rows = wide.dropna(subset=["target", "delta_besok"])
    clf = models.three_class(rows, columns, "target", LABELS).withColumnRenamed("y_pred", "y_pred_clf")
    reg, _ = models.boosted_delta(clf, columns, "delta_besok", "kurs_jisdor", rounds=rounds)
    return _sunk(reg.withColumnRenamed("y_pred", "y_pred_reg"), "text")


def fuse_early(wide: DataFrame, group: str = "basic", embedding: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """Stored predictions of one model over series and a group of text columns; ``embedding`` is a table of daily vectors by date."""
    rows = joins.numbered_features(wide, embedding, "date") if embedding is not None else wide
    return _sunk(models.early_fusion(rows, group, "target", LABELS, "delta_besok", "kurs_jisdor", rounds), f"early {group}")


def fuse_late(wide: DataFrame, rounds: int = 20) -> Tables:
    """``predictions`` of two models mixed by the weights that were best on val, and the ``weights`` with their scores."""
    text = [c for c in models.feature_group(wide, "basic") if c not in models.SERIES_FEATURES]
    rows = wide.dropna(subset=["target", "delta_besok", *models.SERIES_FEATURES])
    step = rows
    for name, columns in (("a", list(models.SERIES_FEATURES)), ("b", text)):
        step = models.three_class(step, columns, "target", LABELS)
        step = step.select(*[c for c in step.columns if c not in ("probabilities", "y_pred")], *[F.col("probabilities")[i].alias(f"{name}{i + 1}") for i in range(3)])
        step, _ = models.boosted_delta(step, columns, "delta_besok", "kurs_jisdor", rounds=rounds)
        step = step.withColumnRenamed("y_pred", f"r{name}")
    step = cut(step.filter("split <> 'train'"), "fused")
    a, b = ("a1", "a2", "a3"), ("b1", "b2", "b3")
    best = cut(metrics.late_fusion(step, "split", "target", a, b, "kurs_besok", "ra", "rb", LABELS), "best")
    mixed = step.join(F.broadcast(best.select("split", "w_clf", "w_reg")), "split")
    scores = F.array(*[F.col("w_clf") * F.col(x) + (1 - F.col("w_clf")) * F.col(y) for x, y in zip(a, b, strict=True)])
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(scores, F.array_max(scores)).cast("int"))
    out = mixed.withColumn("y_pred_clf", label).withColumn("y_pred_reg", F.col("w_reg") * F.col("ra") + (1 - F.col("w_reg")) * F.col("rb"))
    return {"predictions": _sunk(out, "late"), "weights": best}


def embedding_model(name: str, docs: DataFrame, wide: DataFrame, tokens: str = "tokens", rounds: int = 20, **options) -> Tables:
    """``features`` by day of a static embedding fitted on train, and ``predictions`` with them; ``docs`` has day, split and tokens."""
    pooled = cut(embeddings.embedding_features(name, docs, "day", tokens, **options), "pooled")
    dims = len((pooled.select("vector").first() or [[]])[0])
    daily = models.widened(pooled.withColumnRenamed("day", "date"), "vector", "v", dims)
    return {"features": daily, "predictions": fuse_early(wide, "embedding", daily, rounds)}


def topic_model(docs: DataFrame, key: str, tokens: str, wide: DataFrame | None = None, candidates: tuple[int, ...] = (8, 10, 12, 15), k: int | None = None, rounds: int = 20, **options) -> Tables:
    """``counts`` of candidate topics with their coherence, ``articles`` with their topics, ``terms``, and with ``wide`` also ``predictions``."""
    out: Tables = {}
    if k is None:
        k, out["counts"] = models.choose_topics(docs, key, tokens, candidates, "split = 'train'", **options)
    shares, out["terms"] = models.topics(docs, key, tokens, k=k, fit_on="split = 'train'", **options)
    out["articles"] = cut(shares.join(docs.select(key, "day", "split"), key), "topics")
    if wide is not None:
        known = out["articles"].filter("dominant_topic >= 0")
        daily = features.as_vectors(features.pooled(known, "day", "shares"), "day").withColumnRenamed("day", "date")
        out["predictions"] = fuse_early(wide, "embedding", models.widened(daily, "vector", "topic_", k), rounds)
    return out


def error_analysis(base: DataFrame, candidate: DataFrame, split: str = "test") -> DataFrame:
    """How often a candidate's predictions help or hurt against a base, the exact test and the correlation of errors."""
    pick = lambda df: df if split == "all" else df.filter(F.col("split") == split)
    both = joins.compare(pick(base), pick(candidate), ["date"], ["correct_clf", "err_reg"])
    if both.isEmpty():
        raise contracts.ContractError("the predictions share no day")
    right = both.withColumn("b", F.col("correct_clf_base") == 1).withColumn("c", F.col("correct_clf_cand") == 1)
    correlation = both.agg(F.round(metrics.guarded_correlation(F.col("err_reg_base"), F.col("err_reg_cand")), 4).alias("error_correlation"))
    return metrics.contingency(right, "b", "c").crossJoin(F.broadcast(correlation))


# --- the whole

#: What a run writes below its folder; nothing else is ever deleted.
OUTPUTS = ("rates", "split", "articles", "aligned", "scores", "wide", "predictions", "comparison")


def run_pipeline(spark: SparkSession, inputs: Tables, folder: str, clean: bool = False, rounds: int = 20, first: str | None = None, last: str | None = None) -> Tables:
    """Rates, articles and a lexicon to predictions and their comparison.

    ``inputs``: ``rates`` as text, ``articles (article_id, url, title,
    published_at timestamp, body, status)``, ``lexicon (word, category)``,
    ``valences (word, valence)`` and, if there are any, ``holidays (day)``. Each
    stage is written below ``folder`` and read back; ``clean`` deletes what an
    earlier run left there.
    """
    for name in ("rates", "articles", "lexicon", "valences"):
        if name not in inputs:
            raise contracts.ContractError(f"missing input: {name}")
    if clean:
        files.clean_outputs(spark, folder, OUTPUTS)
    with temporary_cuts(spark):
        return _run(spark, inputs, folder, rounds, first, last)


def _run(spark: SparkSession, inputs: Tables, folder: str, rounds: int, first: str | None, last: str | None) -> Tables:
    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rates = stage("rates", preprocess_rates(inputs["rates"])["rates"])
    lagged = series.lagged_returns(rates)
    days = formulate_targets(rates).join(lagged.drop("rate"), "date")
    split = stage("split", split_dataset(days)["split"].withColumnsRenamed({"rate": "kurs_jisdor", "rate_next": "kurs_besok", "delta_next": "delta_besok"}))
    bounds = rates.agg(F.min("date"), F.max("date")).first()
    cleaned = articles.clean_articles(inputs["articles"], "article_id", str(first or bounds[0]), str(last or bounds[1]))
    news = stage("articles", cleaned["unique"])
    aligned = stage("aligned", align_articles(news, split.select("date", "split"), inputs.get("holidays")))
    categories = tuple(sorted(r[0] for r in inputs["lexicon"].select("category").distinct().collect()))
    scores = articles.article_scores(aligned, inputs["lexicon"], inputs["valences"], "article_id", categories)
    scores = stage("scores", scores.join(aligned.select("article_id", F.col("trading_date").alias("day")), "article_id"))
    bags = aligned.select(F.col("trading_date").alias("day"), F.filter(F.split(F.concat_ws(" ", "title_bow", "body_bow"), " "), lambda w: w != "").alias("tokens"), "split")
    counts = cut(features.term_counts(bags.select("day", "tokens"), "day", "tokens"), "counts")
    train = counts.join(split.filter("split = 'train'").select(F.col("date").alias("day")), "day", "left_semi")
    n = train.agg(F.count_distinct("day").alias("n"))
    weights = features.tfidf(counts, cut(features.vocabulary(train, n, 5, 0.8, 2000), "vocabulary"), n, "day")
    wide = stage("wide", model_dataset(scores, split, weights))
    late = fuse_late(wide, rounds)
    stored = [series_model(wide, rounds), text_model(wide, rounds), fuse_early(wide, "basic", rounds=rounds), late["predictions"]]
    union = stored[0]
    for one in stored[1:]:
        union = union.unionByName(one)
    predictions = stage("predictions", union)
    naive = naive_baselines(split.withColumnsRenamed({"kurs_jisdor": "rate", "kurs_besok": "rate_next"}))["comparison"].filter("split <> 'train'")
    scored = score_predictions(predictions).withColumn("task", F.lit("both"))
    comparison = stage("comparison", naive.unionByName(scored, allowMissingColumns=True))
    files.require_outputs(spark, [f"{folder}/{name}" for name in OUTPUTS])
    return {"split": split, "aligned": aligned, "wide": wide, "predictions": predictions, "comparison": comparison}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m tidewire COMMAND``: preprocess-rates, targets, split, naive, metrics, errors, news, demo."""
    parser = argparse.ArgumentParser(prog="tidewire")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **numbers: float | str) -> None:
        one = commands.add_parser(name)
        for p in paths:
            one.add_argument(f"--{p}", required=True)
        for n, default in numbers.items():
            one.add_argument(f"--{n.replace('_', '-')}", dest=n, type=type(default), default=default)

    command("preprocess-rates", "input", "output")
    command("targets", "input", "output", threshold=0.1)
    command("split", "input", "output", train_ratio=0.8, val_ratio=0.1)
    command("naive", "input", "output")
    command("metrics", "input", "output")
    command("errors", "baseline", "candidate", "output", split="test")
    command("news", "input", "output", stage="all", thresh_geo=0.15, thresh_rate=0.15, clusters=4, seed=42, jaccard=0.8)
    command("demo", "output")
    a = parser.parse_args(argv)
    from tidewire.runtime import build_session

    spark = spark or build_session()

    def preprocess() -> Tables:
        return {"": preprocess_rates(files.read_text_csv(spark, a.input, ["tanggal", "kurs_jisdor"]))["rates"]}

    def news(records: DataFrame) -> Tables:
        staged = news_stages(records, a.stage, least_first=a.thresh_geo, least_second=a.thresh_rate, clusters=a.clusters, seed=a.seed, similar=a.jaccard)
        return {f"/{k}": v for k, v in staged.items()}

    read = lambda: spark.read.parquet(a.input)
    runs: dict[str, Callable[[], Tables]] = {
        "preprocess-rates": preprocess,
        "targets": lambda: {"": formulate_targets(read(), a.threshold)},
        "split": lambda: {f"/{k}": v for k, v in split_dataset(read(), a.train_ratio, a.val_ratio).items()},
        "naive": lambda: {f"/{k}": v for k, v in naive_baselines(read()).items()},
        "metrics": lambda: {"": score_predictions(read())},
        "errors": lambda: {"": error_analysis(spark.read.parquet(a.baseline), spark.read.parquet(a.candidate), a.split)},
        "news": lambda: news(files.read_html_folder(spark, a.input) if not a.input.endswith(".json") else spark.read.option("multiLine", True).json(a.input)),
        "demo": lambda: {f"/{k}": v for k, v in news_stages(demo_pages(spark)).items()},
    }
    for name, df in runs[a.command]().items():
        df.write.mode("overwrite").parquet(f"{a.output}{name}")
    return 0
