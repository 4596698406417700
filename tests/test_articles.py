"""Article composition on small rows with every awkward case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.operators import articles


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v")).alias("o")).collect()]


def test_word_tokens_have_borders_of_any_script(spark):
    assert one(spark, t.word_tokens, "café rate's Ünal don't x2") == [["rate", "don't", "x2"]]
    assert one(spark, t.embedding_tokens, "Café O'Neil's a_b 東京") == [["café", "o'neil", "s", "a", "b", "東京"]]


def test_deduplicated_paragraphs(spark):
    text = "One two three four.\n one  TWO three four.\n\nOne two three four five.\n!!\n!!\n??\nlast"
    kept, exact, near = one(spark, t.deduplicated, text)[0]
    assert (kept, exact, near) == (["One two three four.", "One two three four five.", "!!", "??", "last"], 2, 0)
    kept, exact, near = one(spark, t.deduplicated, "a b c d e f g h i j k l\nA b c d e f g h i j k l m\nz")[0]
    assert (kept, exact, near) == (["a b c d e f g h i j k l", "z"], 0, 1)


def test_light_clean(spark):
    text = "Café &lt;b&gt;x&lt;/b&gt; &amp; y z​w\nmail a.b@c.example or www.x.example/q now\nCafé &lt;b&gt;x&lt;/b&gt; &amp; y z​w"
    assert one(spark, t.light_clean, text, None, "", " \n ") == ["Café x & y zw mail EMAIL or URL now", "", "", ""]
    assert one(spark, lambda c: t.light_clean(c, keep_lines=True), "a\n\n\n\nb  c") == ["a\n\nb c"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(t.ngrams(F.col("w"), 3)).collect()] == [["a_b_c"], [], []]


def rows(spark):
    base = {"author": "A", "title": "War and tariff", "published_at": "2024-01-01", "body": "the trade war, the War", "discovery_title": "x", "url": "u"}
    some = [base, base | {"author": "  "}, base | {"title": None}, base | {"title": "tariffs", "body": "warm"}, base | {"title": "t", "body": "b", "discovery_title": "Summit"}]
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(some)], "id int, author string, title string, published_at string, body string, discovery_title string, url string")


def test_filter_news(spark):
    out = {r["id"]: r["geopolitical_matches"] for r in articles.filter_news(rows(spark)).collect()}
    assert set(out) == {0, 4}
    assert out[0]["title"] == ["war", "tariff"] and out[0]["body"] == ["trade war", "war"] and out[4]["discovery_title"] == ["summit"]
    with pytest.raises(ValueError, match="missing"):
        articles.filter_news(rows(spark).drop("author"))


def test_assembled_and_preprocessed(spark):
    df = spark.createDataFrame([(1, "T", "b ", None), (2, " ", None, "D"), (3, None, None, None)], "id int, title string, body string, discovery_title string")
    assert [r[0] for r in df.orderBy("id").select(articles.assembled(df)).collect()] == ["T\n\nb", "D", ""]
    out = {r["id"]: r for r in articles.preprocessed(df).collect()}
    assert out[3]["text_final"] == "" and out[3]["unigrams"] == [] and out[1]["text_clean_light"] == "T b"
    made = articles.preprocess_documents(spark.createDataFrame([("Banks cannot raise Rates by 2.5 in New York",)], "text string")).first()
    assert made["unigrams"] == ["bank", "cannot", "raise", "rat", "new", "york"] and made["bigrams"][0] == "bank_cannot"
    assert made["preserved_entities"]["capitalized_candidates"] == ["Banks", "New York", "Rates"] and made["preserved_entities"]["numbers"] == ["2.5"]


def test_composed_text_and_columns(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", " ")], "x string, y string")
    assert [r[0] for r in df.select(articles.composed_text(F.col("x"), F.col("y"))).collect()] == ["a [SEP] b", "b", "a"]
    with pytest.raises(ValueError):
        articles.composed_text(F.col("x"), F.col("y"), "no")
    assert articles.text_columns(spark.createDataFrame([("a", "b")], "title_clean string, body_clean string")) == ("title_clean", "body_clean")
    with pytest.raises(ValueError):
        articles.text_columns(df)


def test_clean_articles_stage_by_stage(spark):
    body = "\n".join(f"The war in place {i} moved the rate of the rupiah by a lot on this day of the year." for i in range(8))
    base = ("https://a.example/x", "War moves rupiah - Wire", "2024-01-02 03:00:00", body, "success")
    some = [base, base, ("https://a.example/y", *base[1:]), ("https://b.example/z", "Other", "2024-01-02 03:00:00", "calm", "success"), ("u", "t", "2020-01-01 00:00:00", body, "success"), ("u", "t", "2024-01-02 03:00:00", None, "failed")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(some)], "article_id int, url string, title string, p string, body string, status string").withColumn("published_at", F.col("p").cast("timestamp")).drop("p")
    stages = articles.clean_articles(df, "article_id", "2024-01-01", "2024-12-31")
    assert {k: v.count() for k, v in stages.items()} == {"status": 5, "period": 4, "clean": 3, "noise": 3, "geo": 3, "length": 3, "unique": 1}
    kept = stages["unique"].first()
    assert kept["article_id"] == 0 and kept["title_clean"] == "War moves rupiah" and "war" in kept["body_bow"]
