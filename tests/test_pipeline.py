"""Entry points from text to predictions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire import contracts, pipeline
from tidewire.operators import embeddings
from tidewire.plans.text_queries import LEXICON


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(4)
    rates, rate = [], 14000
    import datetime

    day = datetime.date(2023, 1, 2)
    while len(rates) < 160:
        if day.weekday() < 5:
            rate += rng.choice([-60, -5, 0, 5, 60])
            rates.append((f"{day.month}/{day.day}/{day.year}", str(rate)))
        day += datetime.timedelta(days=1)
    news, names = [], ["war", "sanctions", "tariff", "summit", "nato"]
    things = [a + b for a in ("nickel", "copper", "cocoa", "palm", "coal", "steam") for b in ("port", "ship", "mine", "yard", "belt")]
    for i in range(420):
        d = datetime.date(2023, 1, 2) + datetime.timedelta(days=i // 2)
        body = "\n".join(f"The {rng.choice(names)} of place {rng.randint(1, 99)} {rng.choice(['lost', 'gained', 'rose', 'slipped'])} again while the {rng.choice(things)} market of the rupiah {rng.choice(['slipped', 'firmed'])} in early trade today." for _ in range(8))
        news.append((i, f"https://s.example/{i}", f"The {rng.choice(names)} number {i}", f"{d} {rng.randint(0, 23):02d}:30:00", body, "success"))
    articles = spark.createDataFrame(news, "article_id bigint, url string, title string, p string, body string, status string").withColumn("published_at", F.col("p").cast("timestamp")).drop("p")
    lexicon = spark.createDataFrame([(w, c) for c, ws in LEXICON.items() for w in ws], "word string, category string")
    return {"rates": spark.createDataFrame(rates, "tanggal string, kurs_jisdor string"), "articles": articles, "lexicon": lexicon, "valences": lexicon.select("word", F.when(F.col("category") == "positive", 2.0).otherwise(-2.0).alias("valence"))}


@pytest.fixture(scope="module")
def result(spark, inputs, tmp_path_factory):
    return pipeline.run_pipeline(spark, inputs, str(tmp_path_factory.mktemp("run")), clean=True, rounds=3)


def test_run_pipeline(result):
    compared = result["comparison"].collect()
    assert {(r["model"], r["split"]) for r in compared} >= {(m, s) for m in ("series", "text", "early basic", "late", "persistence", "majority", "random walk") for s in ("val", "test")}
    wide = result["wide"]
    assert wide.groupBy("date").count().filter("count > 1").isEmpty() and {"no_news", "lm_net_mean", "tfidf_svd_1"} <= set(wide.columns)
    # No row of a day's news comes from another split.
    assert wide.filter("news_date <= date").isEmpty()
    # The random walk's skill against itself is none.
    assert all(abs(r["skill_vs_naive"]) < 1 for r in compared if r["model"] in ("series", "late"))


def test_missing_input_is_an_error(spark, inputs, tmp_path):
    with pytest.raises(contracts.ContractError, match="lexicon"):
        pipeline.run_pipeline(spark, {k: v for k, v in inputs.items() if k != "lexicon"}, str(tmp_path))


def test_features_of_train_do_not_see_test(spark, inputs, result):
    """Other news in test leaves the rows of train as they are."""
    from tidewire.operators import articles

    days = result["split"].select("date", "split")
    aligned = result["aligned"]
    test = aligned.filter("split = 'test'").withColumn("body_clean", F.lit("war war war."))
    score = lambda df: articles.article_scores(df, inputs["lexicon"], inputs["valences"], "article_id", tuple(LEXICON)).join(df.select("article_id", F.col("trading_date").alias("day")), "article_id")
    a, b = (articles.daily_features(score(df), days, "day").filter("split = 'train'") for df in (aligned, aligned.filter("split <> 'test'").unionByName(test)))
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert rounded(a) == rounded(b.select(a.columns))


def test_embeddings_topics_and_errors(spark, result):
    docs = result["aligned"].select("article_id", F.col("trading_date").alias("day"), "split", F.split("title_bow", " ").alias("tokens"))
    made = pipeline.embedding_model("word2vec", docs, result["wide"], rounds=2, dims=4, iterations=1)
    assert made["features"].columns[:2] == ["date", "v1"] and made["predictions"].count() > 0
    topics = pipeline.topic_model(docs, "article_id", "tokens", result["wide"], (2, 3), rounds=2, iterations=2, min_df=1)
    assert topics["counts"].count() == 2 and topics["predictions"].count() > 0
    predictions = result["predictions"]
    got = pipeline.error_analysis(predictions.filter("model = 'series'"), predictions.filter("model = 'late'")).first()
    n = predictions.filter("model = 'series' and split = 'test'").count()
    assert got["helped"] + got["hurt"] + got["both_right"] + got["both_wrong"] == n and 0 <= got["p"] <= 1
    with pytest.raises(contracts.ContractError):
        pipeline.error_analysis(predictions.limit(0), predictions)


def test_fasttext_gives_unknown_words_a_vector(spark):
    docs = spark.createDataFrame([(i % 3, "train", ["rupiah", "falls", "as", "dollar", "gains"] * 3) for i in range(20)], "day int, split string, tokens array<string>")
    model = embeddings.make_embedding(" FastText ", dims=6, buckets=500, rounds=2, least=1).fit(docs, "tokens")
    other = spark.createDataFrame([(9, ["rupiahs", "unseen"]), (10, [])], "day int, tokens array<string>")
    got = {r["day"]: r["vector"] for r in model.transform(other, "day", "tokens").collect()}
    assert len(got[9]) == 6 and any(got[9]) and got[10] == [0.0] * 6
    with pytest.raises(ValueError, match="glove"):
        embeddings.make_embedding("other")
    with pytest.raises(ValueError):
        embeddings.make_embedding("glove").fit(docs, "tokens")


def test_glove_ignores_unknown_words(spark):
    source = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0])], "term string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["x"])], "day int, tokens array<string>")
    got = {r["day"]: r["vector"] for r in embeddings.make_embedding("glove", dims=2, source=source).fit(docs, "tokens").transform(docs, "day", "tokens").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_news_stages_on_the_demo(spark, tmp_path):
    stages = pipeline.news_stages(pipeline.demo_pages(spark), clusters=2)
    assert {k: v.count() for k, v in stages.items()} == {"cleaning": 3, "filtering": 1, "preprocessing": 1}
    made = stages["preprocessing"].first()
    assert made["title"].startswith("Sanctions") and made["author"] == "A. Writer" and "URL" in made["text_final"] and made["text_final"].count("raise the threat") == 1
    assert set(pipeline.news_stages(pipeline.demo_pages(spark), "cleaning")) == {"cleaning"}
    with pytest.raises(ValueError):
        pipeline.news_stages(pipeline.demo_pages(spark), "some")


def test_commands(spark, inputs, tmp_path):
    inputs["rates"].coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    for argv in (["preprocess-rates", "--input", "raw", "--output", "rates"], ["targets", "--input", "rates", "--output", "days"], ["split", "--input", "days", "--output", "split"], ["naive", "--input", "split/split", "--output", "naive"], ["demo", "--output", "demo"]):
        at = [str(tmp_path / a) if i and argv[i - 1] in ("--input", "--output") else a for i, a in enumerate(argv)]
        assert pipeline.main(at, spark) == 0
    assert spark.read.parquet(str(tmp_path / "naive/comparison")).count() == 9
    assert spark.read.parquet(str(tmp_path / "demo/preprocessing")).count() == 1


def test_charts(spark, inputs):
    rates = pipeline.preprocess_rates(inputs["rates"])["rates"]
    events = spark.createDataFrame([("2023-01-03", "a"), ("1990-01-01", "b")], "d string, name string").select(F.to_date("d").alias("day"), "name")
    charts = pipeline.rate_charts(rates, events)
    assert charts["events"].count() == 1 and charts["yearly"].count() == 1


def test_models_are_stored_and_loaded(spark, tmp_path):
    from tidewire.operators.models import TopicModel

    docs = spark.createDataFrame([(i, ["rupiah", "dollar", "rate"] if i % 2 else ["war", "troops", "border"]) for i in range(40)] + [(99, ["unknown"])], "id int, tokens array<string>")
    model = TopicModel(k=2, iterations=5, min_df=2, max_df=0.95).fit(docs, "tokens")
    model.save(str(tmp_path / "topics"))
    same = lambda m: {r["id"]: [round(x, 6) for x in r["shares"]] for r in m.transform(docs, "id").collect()}
    assert same(TopicModel.load(str(tmp_path / "topics"))) == same(model) and same(model)[99] == [0.0, 0.0]
    with pytest.raises(ValueError):
        TopicModel(k=1)
    with pytest.raises(ValueError):
        TopicModel().transform(docs, "id")
    for name, options in (("word2vec", {"dims": 3, "iterations": 1, "least": 1}), ("fasttext", {"dims": 3, "buckets": 50, "rounds": 1, "least": 1})):
        fitted = embeddings.make_embedding(name, **options).fit(docs, "tokens")
        fitted.save(str(tmp_path / name))
        loaded = embeddings.make_embedding(name, **options).load(spark, str(tmp_path / name))
        rounded = lambda m: {r["id"]: [round(x, 6) for x in r["vector"]] for r in m.transform(docs, "id", "tokens").collect()}
        assert rounded(loaded) == rounded(fitted)
