"""Small cases with ties, nulls and empty tables, and properties that must hold."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire import contracts
from tidewire.functions import text as t
from tidewire.operators import calendar, features, joins, metrics, models, series
from tidewire.sources import files

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first()[0]


def days(spark, rates):
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(rates)], "n int, rate double").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("date"), "rate")


def test_labels_are_strict(spark):
    df = spark.createDataFrame([(0.1,), (0.11,), (-0.1,), (-0.2,), (None,)], "c double").select(series.label(F.col("c")).alias("l"))
    assert [r[0] for r in df.collect()] == ["STABIL", "NAIK", "STABIL", "TURUN", None]


@FEW
@given(n=st.integers(20, 200), embargo=st.integers(0, 3))
def test_split_is_disjoint_and_in_order(spark, n, embargo):
    out = series.chronological_split(days(spark, [1.0] * n), embargo=embargo)
    contracts.require_chronological(out)
    assert out.count() == n - 2 * embargo and out.select("date").distinct().count() == out.count()


def test_split_refuses_bad_shares(spark):
    with pytest.raises(ValueError):
        series.chronological_split(days(spark, [1.0]), train=0.9, val=0.2)


def test_rolling_deviation_needs_five_returns(spark):
    out = [r[0] for r in series.lagged_returns(days(spark, [1, 2, 3, 4, 5, 6, 7])).orderBy("date").select("ret_std5").collect()]
    assert out[:5] == [None] * 5 and out[5] > 0


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None)], "s string, v string")
    assert series.most_frequent(df, "v", "s").first()["v"] == "x"


def test_alignment_contract(spark):
    cal = calendar.trading_calendar(spark, "2022-12-20", "2023-02-01", spark.createDataFrame([("2022-12-26",)], "d string").select(F.col("d").cast("date").alias("day")))
    rows = spark.createDataFrame([(1, "2023-01-16 09:00:00"), (2, "2023-01-16 17:30:00"), (3, "2022-12-25 08:00:00"), (4, "2022-12-25 23:00:00"), (5, "2023-01-20 16:00:00")], "id int, s string")
    got = {r["id"]: str(r["trading_date"]) for r in calendar.align(rows, cal, F.to_timestamp_ntz("s")).collect()}
    assert got == {1: "2023-01-16", 2: "2023-01-17", 3: "2022-12-27", 4: "2022-12-27", 5: "2023-01-23"}


def test_windows_clip_the_last(spark):
    got = [(str(a), str(b)) for a, b in calendar.windows(spark, "2024-01-01", "2024-01-10").orderBy("start").collect()]
    assert got == [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-10")]


def test_keep_first_in_turn_sees_survivors(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "v", "b"), (4, None, "c")], "id int, url string, title string")
    assert sorted(r[0] for r in joins.keep_first_in_turn(df, [["url"], ["title"]], ["id"]).collect()) == [1, 3, 4]


def test_cosine_pairs_equal_brute_force(spark):
    docs = [["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "b", "c", "e"], ["x"], ["a", "b", "c", "d", "d"], []]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, w array<string>")
    counts = features.term_counts(df, "id", "w")
    weights = features.tfidf(counts, features.document_frequency(counts), df.agg(F.count(F.lit(1)).alias("n")), "id")
    vectors = {}
    for i, term, w in weights.collect():
        vectors.setdefault(i, {})[term] = w
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(x, 0) for x, w in vectors[a].items()) >= 0.9}
    assert {(r["a"], r["b"]) for r in joins.similar_earlier(weights).collect()} == want


def test_mcnemar_published_values(spark):
    df = spark.createDataFrame([(11, 23), (9, 9), (0, 0)], "h bigint, u bigint").select(metrics.mcnemar(F.col("h"), F.col("u")).alias("p"))
    assert [round(r[0], 4) for r in df.collect()] == [0.0576, 1.0, 1.0]


def test_metrics_of_a_published_matrix(spark):
    cells = [[20, 12, 11], [15, 20, 12], [8, 16, 5]]
    rows = [(series.LABELS[i], series.LABELS[j], n) for i, r in enumerate(cells) for j, n in enumerate(r)]
    got = metrics.classification(spark.createDataFrame(rows, "y_true string, y_pred string, n bigint")).first()
    assert round(got["accuracy"], 4) == 0.3782 and round(got["macro_f1"], 4) == 0.3539 and round(got["balanced_accuracy"], 4) == 0.3544


def test_spearman_shares_ranks(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (None, 4.0)], "a double, b double")
    assert math.isclose(metrics.spearman(df, "a", "b").first()["spearman"], 0.8660254, rel_tol=1e-6)


def test_no_leakage_from_test_rows(spark):
    docs = spark.createDataFrame([(1, "train", ["a", "b"]), (2, "train", ["a", "c"]), (3, "test", ["a", "z"])], "id int, split string, w array<string>")

    def weights(df):
        counts = features.term_counts(df, "id", "w")
        train = df.filter("split = 'train'")
        n = train.agg(F.count(F.lit(1)).alias("n"))
        out = features.tfidf(counts, features.vocabulary(features.term_counts(train, "id", "w"), n), n, "id")
        return sorted(map(tuple, out.filter("id < 3").collect()))

    changed = docs.withColumn("w", F.when(F.col("split") == "test", F.array(F.lit("b"), F.lit("q"))).otherwise(F.col("w")))
    assert weights(docs) == weights(changed)


@FEW
@given(a=st.lists(st.sampled_from("abcd"), max_size=8), b=st.lists(st.sampled_from("abcd"), max_size=8))
def test_jaccard_is_symmetric(spark, a, b):
    x = one(spark, F.struct(t.jaccard(t.shingles(F.col("a")), t.shingles(F.col("b"))).alias("p"), t.jaccard(t.shingles(F.col("b")), t.shingles(F.col("a"))).alias("q")), a=" ".join(a), b=" ".join(b))
    assert x["p"] == x["q"] and 0 <= x["p"] <= 1


def test_text_functions(spark):
    assert one(spark, t.normal_url(F.col("a")), a="HTTPS://www.A.example/x/?q=1#f") == "https://a.example/x"
    assert one(spark, t.site_of(F.col("a")), a="http://AMP.News.example:80/x") == "news.example"
    assert one(spark, t.joined_acronyms(F.col("a")), a="The U.S. and U.S.A. met") == "The US and USA met"
    assert one(spark, t.masked(F.col("a")), a="mail a.b@c.com or www.x.example") == "mail EMAIL or URL"
    assert one(spark, t.term_hits(F.col("a"), t.keyword_terms()), a="Trade war and tariffs, war") == ["trade war", "war"]
    assert one(spark, F.transform(t.word_tokens(F.col("a")), t.lemma), a="Cities boxes cats class bus is") == ["city", "box", "cat", "class", "bus", "is"]
    assert one(spark, t.bigrams(t.word_tokens(F.col("a"))), a="one") == []
    assert one(spark, t.clean_paragraphs(F.col("a")), a="JAKARTA (Reuters) - The rupiah fell again today\nshort one\nThe rupiah fell again today\nRead more: the rupiah fell again") == "The rupiah fell again today"
    assert one(spark, t.unique_paragraphs(F.col("a")), a="a b c d e f\nA b  c d e f\nx y z") == ["a b c d e f", "x y z"]
    assert one(spark, t.fnv1a(F.col("a"), 1 << 32), a="hello") == 0x4F9F2CAB
    assert one(spark, t.character_grams(F.col("a")), a="ab") == ["<ab", "ab>", "<ab>"]


def test_null_texts_do_not_crash(spark):
    for f in (t.normal_url, t.site_of, t.joined_acronyms, t.masked, t.word_tokens, t.clean_paragraphs, t.light_clean, t.entities, t.shingles):
        one(spark, f(F.col("a")), a=None)
        one(spark, f(F.col("a")), a="")


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for broken in (lambda: contracts.require_unique(df, "k"), lambda: contracts.require_columns(df, "z"), lambda: contracts.require_members(df, "v", ("a",)), lambda: contracts.join_many_to_one(df, df, ["k"])):
        with pytest.raises(contracts.ContractError):
            broken()
    contracts.require_unique(df, "k", "v")


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n<<<<<<< x\n3,4\n=======\n>>>>>>> y\n")
    assert files.read_text_csv(spark, str(tmp_path / "r.csv"), ["a", "b"]).count() == 2
    with pytest.raises(contracts.ContractError):
        files.read_text_csv(spark, str(tmp_path / "r.csv"), ["a"], skip_conflicts=False)
    with pytest.raises(contracts.ContractError):
        files.read_text_csv(spark, str(tmp_path / "r.csv"), ["c"])
    (tmp_path / "v.txt").write_text("3 2\nx 1 2\ny 1 nan\nz 1\nw 3 4\n")
    assert sorted(r[0] for r in files.read_vectors(spark, str(tmp_path / "v.txt"), 2).collect()) == ["w", "x"]
    assert files.read_vectors(spark, str(tmp_path / "v.txt"), 2, spark.createDataFrame([("x",)], "term string")).count() == 1
    (tmp_path / "d.csv").write_text("Word,Negative,Positive\nLOSS,2009,0\nGAIN,0,2009\n")
    assert sorted(map(tuple, files.read_dictionary(spark, str(tmp_path / "d.csv"), ["Negative", "Positive"]).collect())) == [("gain", "positive"), ("loss", "negative")]
    (tmp_path / "f.xml").write_text('<rss><channel><item><title>T</title><link>L</link><pubDate>P</pubDate><source url="u">S</source></item></channel></rss>')
    assert tuple(files.read_feed_xml(spark, str(tmp_path / "f.xml")).first()) == ("T", "L", "P", "S", "u")
    pages = tmp_path / "pages"
    pages.mkdir()
    with pytest.raises(contracts.ContractError):
        files.read_html_folder(spark, str(pages))
    (pages / "b.html").write_text("<title>B</title>")
    (pages / "a.html").write_text("<title>A</title>")
    assert [r[0] for r in files.read_html_folder(spark, str(pages)).collect()] == ["a.html", "b.html"]


def test_page_fields():
    page = '<title>T &amp; U</title><time datetime="2024-01-01"></time><a class="Author-authorName">N</a><a class="Author-authorName">M</a><nav><p>menu</p></nav><article><p>One</p><p>Two</p><p>One</p></article><p>Out</p><script type="application/ld+json">{"a": 1}</script>'
    assert files.page_fields(page) == ("T & U", "2024-01-01", "N", "One\nTwo\nOne", ['{"a": 1}'], None, "One\nTwo")
    assert files.page_fields(None) == files.page_fields(" ") == (None,) * 7
    assert files.page_fields("<title>&amp;lt;b</title>")[0] == "&lt;b"


def test_inner_elements_close_nothing_but_themselves():
    main = '<div class="ArticleBody-main"><p>one</p><div><p>two</p></div><p>three</p></div><div><p>side</p></div>'
    assert files.page_fields(main)[3] == "one\ntwo\nthree" and files.page_fields(main)[6] == "one\ntwo\nthree"
    assert files.page_fields('<div class="ArticleBody-main"><div><p>two</p></div><p>three</p></div><aside><p>side</p></aside>')[3] == "two\nthree"
    assert files.page_fields("<p>one<p>two <b>bold</b><br>more")[3] == "one\ntwo bold more"


def test_article_text_takes_the_most_specific_place_of_three():
    page = "<div class='article-content x'><p>a</p><p>b</p></div><article><p>c</p><p>d</p><p>c</p></article>"
    assert files.page_fields(page)[6] == "c\nd"
    assert files.page_fields("<article><p>c</p><p>d</p></article>")[6] is None


def test_linked_articles(spark):
    rows = [
        (1, ['{"@type": "NewsArticle", "headline": "H", "datePublished": "D", "author": {"name": "A"}}'], "x"), (2, ['[{"@type": ["Article"], "headline": "I", "author": [{"name": "A"}, {"name": "B"}]}]'], "x"),
        (3, ["{broken"], "heading"), (4, ['{"@type": "Thing"}'], None), (5, ['{"@type": "WebPage"}', "{broken", '{"@type": "NewsArticle", "headline": "J"}'], "x"),
        (6, ['[{"@type": "WebPage"}, {"@type": "NewsArticle", "headline": "K", "articleBody": " body "}]'], "x"), (7, [], None), (8, None, None),
    ]
    out = files.linked_articles(spark.createDataFrame(rows, "id int, s array<string>, h string"), "s", "h").collect()
    got = {r["id"]: (r["headline"], r["authors"]) for r in out}
    assert got == {1: ("H", "A"), 2: ("I", "A, B"), 3: ("heading", None), 4: (None, None), 5: ("J", None), 6: ("K", None), 7: (None, None), 8: (None, None)}
    assert next(r for r in out if r["id"] == 6)["article_body"] == "body"


def test_columns_in_numeric_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x_10 int, x_2 int, x_a int")
    assert models.columns_of(df, "x_") == ["x_2", "x_10"]


def test_keep_first_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert sorted(r[0] for r in joins.keep_first(df, ["k"], ["id"]).collect()) == [1, 3, 4, 5]
    plan = joins.keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_small_relational_operators(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "id int, v string, w string")
    other = spark.createDataFrame([(1, "a", 7), (3, "c", 8)], "id int, v string, extra int")
    assert sorted(map(tuple, joins.repaired(df, other, ["id"]).select("id", "v", "w", "extra").collect())) == [(1, "a", "x", 7), (2, "b", "y", None)]
    numbered = joins.numbered_features(df.select("id"), other.select("id", F.lit(5).alias("some"), "extra"), "id")
    assert numbered.columns == ["id", "emb_1", "emb_2"] and sorted(map(tuple, numbered.collect())) == [(1, 5.0, 7.0), (2, 0.0, 0.0)]
    union = joins.tagged_union({"p": df.select("id"), "q": other.select("extra")})
    assert union.count() == 4 and union.filter("id is null").count() == 2
    assert [r["w"] for r in joins.in_order(df, "w", ("y", "x")).collect()] == ["y", "x"]
    assert joins.seeded_sample(df, "id", 1).collect() == joins.seeded_sample(df, "id", 1).collect()


def test_feature_groups(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "lm_net_mean double, tfidf_svd_10 double, tfidf_svd_2 double, emb_1 double")
    assert models.feature_group(df, "basic", ("r",)) == ["r", "lm_net_mean", "tfidf_svd_2", "tfidf_svd_10"]
    assert models.feature_group(df, "both", ())[-1] == "emb_1" and models.feature_group(df, "none", ("r",)) == ["r"]
    with pytest.raises(ValueError):
        models.feature_group(df.drop("emb_1"), "embedding")


def test_packed_vectors(spark, tmp_path):
    import zipfile

    raw = files.binary_vectors([("x", [1.0, 2.0]), ("naïve", [3.0, -4.5])])
    (tmp_path / "v.bin").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("inner.txt", "2 2\nx 1 2\ny 3 4\n")
    assert {r[0]: list(r[1]) for r in files.read_packed_vectors(spark, str(tmp_path / "v.bin"), 2).collect()} == {"x": [1.0, 2.0], "naïve": [3.0, -4.5]}
    cache = str(tmp_path / "cache")
    needed = spark.createDataFrame([("y",)], "term string")
    assert [r[0] for r in files.read_packed_vectors(spark, str(tmp_path / "v.zip"), 2, needed, cache=cache).collect()] == ["y"]
    assert files.read_packed_vectors(spark, "nowhere", 2, cache=cache).count() == 2
    with pytest.raises(Exception, match="numbers"):
        files.read_packed_vectors(spark, str(tmp_path / "v.bin"), 3).collect()
    (tmp_path / "t.txt").write_text("x 1 2\ny 1\n")
    with pytest.raises(contracts.ContractError):
        files.read_vectors(spark, str(tmp_path / "t.txt"), 2, strict=True)


def test_clean_outputs_deletes_what_is_listed(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    assert files.clean_outputs(spark, str(tmp_path), ("a", "c")) == ["a"]
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()
    for bad in ("../x", "/etc", ""):
        with pytest.raises(contracts.ContractError):
            files.clean_outputs(spark, str(tmp_path), (bad,))


def test_feeds_and_pages_never_raise(spark, tmp_path):
    from tidewire.sources import web

    (tmp_path / "f.xml").write_text('<rss><channel><item><title>T</title><link>L</link><source url="u">S</source></item></channel></rss>')
    (tmp_path / "bad.xml").write_text("<rss>")
    found = web.read_feeds(spark, [f"file://{tmp_path}/{n}" for n in ("f.xml", "bad.xml", "none.xml")]).collect()
    assert [tuple(r)[:5] for r in found] == [("T", "L", None, "S", "u")]
    assert web.read_feeds(spark, []).count() == 0
    (tmp_path / "p.html").write_text("<h1>Head</h1><article>" + "<p>" + "</p><p>".join(f"paragraph {i} " + "word " * 30 for i in range(4)) + "</p></article>")
    (tmp_path / "s.html").write_text("<p>short</p>")
    rows = {r["url"].rsplit("/", 1)[1]: r for r in web.read_pages(spark, [f"file://{tmp_path}/{n}" for n in ("p.html", "s.html", "none.html")]).collect()}
    assert rows["p.html"]["status"] == "success" and rows["p.html"]["title"] == "Head" and rows["p.html"]["error"] is None
    assert rows["s.html"]["status"] == "failed" and "short" in rows["s.html"]["error"]
    assert rows["none.html"]["status"] == "failed" and rows["none.html"]["body"] is None


def test_cuts_are_deleted_at_the_end(spark):
    import os

    from tidewire import runtime

    with runtime.temporary_cuts(spark):
        runtime.cut(spark.range(3), "some")
        path = runtime._CUTS[-1].removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from tidewire.streaming import news

    def put(rows):
        spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp_ntz("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = news.stream_table(spark, str(tmp_path / "in"), "k string, ts timestamp_ntz")
        news.run_to_table(news.first_seen(stream, "k", "ts", "2 days").select("k"), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00"), ("a", "2024-01-01 02:00:00")])
    assert run() == ["a", "b"]
    put([("a", "2024-01-01 03:00:00"), ("c", "2024-01-10 00:00:00")])
    assert run() == ["a", "b", "c"]
    # Behind the watermark: late, and dropped; beyond the state's time: seen anew.
    put([("d", "2024-01-02 00:00:00"), ("b", "2024-01-11 00:00:00")])
    assert run() == ["a", "b", "b", "c"]
    assert run() == ["a", "b", "b", "c"]
