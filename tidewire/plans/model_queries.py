"""Queries of models, sources and streams; most can be checked by their rows alone."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import models
from tidewire.plans.series_queries import LABELS, _ALIGNED, _PERSIST, _calendar, _persistence
from tidewire.plans.text_queries import _bags, _squeezed_sql
from tidewire.runtime import cut, new_folder, table
from tidewire.sources import files
from tidewire.streaming import news

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["log_return", "ret_lag1", "ret_lag2", "ret_std5"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "daily_kurs_split")


@query()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic shares of every article, fitted on train."""
    docs, _ = models.topics(_bags(spark, sf_dir), "aligned_id", "tokens", fit_on="split = 'train'")
    return docs.select("aligned_id", "dominant_topic", F.round("confidence", 4).alias("confidence"))


@query()
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten top terms of each topic."""
    return models.topics(_bags(spark, sf_dir), "aligned_id", "tokens", fit_on="split = 'train'")[1]


@query()
def word2vec_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted mean vectors per day of a skip-gram model of train."""
    from tidewire.operators.features import pooled_vectors

    bags = cut(_bags(spark, sf_dir).select("day", "split", "tokens"), "bags")
    vectors = cut(models.word_table(bags.filter("split = 'train'"), "tokens"), "vectors")
    return pooled_vectors(bags, vectors, "day", "tokens", 100)


@query()
def pca_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten principal components of the embeddings."""
    out = models.reduced(table(spark, sf_dir, "embeddings"), "embedding", 10)
    return out.select("vec_id", F.round(F.abs(F.col("components")[0]), 4).alias("first"))


@query()
def kmeans_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clusters of the embeddings."""
    return models.clusters(table(spark, sf_dir, "embeddings"), "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def topic_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of several numbers of topics; the first row is the choice."""
    best, scored = models.choose_topics(_bags(spark, sf_dir), "aligned_id", "tokens", (8, 10, 12, 15), fit_on="split = 'train'", iterations=5)
    return scored.select("k", F.round("coherence", 4).alias("coherence"), (F.col("k") == best).alias("chosen"))


@query()
def tfidf_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty coordinates of each day's TF-IDF, fitted on train."""
    from tidewire.plans.text_queries import _weights

    weights = cut(_weights(spark, sf_dir).withColumn("key", F.struct("day", "split")), "weights")
    out, _ = models.truncated_svd(weights, "key", 50, "key.split = 'train'")
    return out.select("key.day", "key.split", F.transform("svd", lambda x: F.round(x, 4)).alias("svd"))


@query()
def embed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of each vector, in place of a neighbour map."""
    out = models.reduced(table(spark, sf_dir, "embeddings"), "embedding", 2)
    return out.select("vec_id", "label", F.round(F.col("components")[0], 4).alias("x"), F.round(F.col("components")[1], 4).alias("y"))


@query("SELECT CASE WHEN label >= 5 AND vec_id % 2 = 1 THEN 1 WHEN label >= 5 THEN 2 WHEN vec_id % 2 = 1 THEN 3 ELSE 4 END AS category, count(*) AS n FROM embeddings GROUP BY 1")
def score_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by two scores and their thresholds."""
    df = table(spark, sf_dir, "embeddings").select((F.col("label") / 10).alias("geo"), (F.col("vec_id") % 2).cast("double").alias("rate"))
    return models.categories(df, "geo", "rate", 0.5, 0.15).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query()
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of three boosted models, on val and test."""
    out = models.boosted_probabilities(_days(spark, sf_dir).dropna(subset=FEATURES), FEATURES, "target", LABELS, rounds=10)
    return out.filter("split <> 'train'").select("date", "split", F.transform("probabilities", lambda x: F.round(x, 4)).alias("probabilities"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.operators import articles
    from tidewire.plans.article_queries import _scores

    days = _days(spark, sf_dir)
    scores = _scores(spark, sf_dir).withColumn("day", F.try_to_date("day", "yyyy-MM-dd"))
    return cut(articles.daily_features(scores, days, "day"), "wide")


@query()
def early_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model of each task over series and lexicon columns."""
    out = models.early_fusion(_wide(spark, sf_dir), "basic", "target", LABELS, "delta_besok", "kurs_jisdor", rounds=10)
    return out.filter("split <> 'train'").select("date", "split", "y_pred_clf", F.round("y_pred_reg", 4).alias("y_pred_reg"))


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forest over series alone, with lexicon columns, and with lexicon columns alone."""
    wide = _wide(spark, sf_dir)
    both = models.feature_group(wide, "basic")
    out = models.ablation(wide, {"series": FEATURES, "both": both, "text": [c for c in both if c not in FEATURES]}, "target", LABELS)
    return out.select("variant", "split", "features", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query()
def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most important columns of the fused regressor."""
    wide = _wide(spark, sf_dir)
    columns = models.feature_group(wide, "basic")
    _, weights = models.boosted_delta(wide.dropna(subset=[*columns, "delta_besok"]), columns, "delta_besok", "kurs_jisdor", rounds=10)
    return spark.createDataFrame(list(weights.items()), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(15)


@query()
def fasttext_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword vectors of titles, trained on train, pooled per day."""
    from tidewire.operators.embeddings import embedding_features

    docs = table(spark, sf_dir, "articles_aligned").select("split", F.col("news_date_wib").alias("day"), text.embedding_tokens(F.coalesce("title_clean", F.lit(""))).alias("tokens"))
    return embedding_features("fasttext", docs, "day", "tokens", dims=32, buckets=20_000, rounds=2)


@query("SELECT vec_id, round(avg(CAST(x AS DOUBLE)), 5) + 0.0::DOUBLE AS mean FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def encoder_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch encoder with a stand-in that reads vectors from text and takes a masked mean."""

    def make_predict():
        def predict(texts):
            import numpy as np

            numbers = [np.array([float(x) for x in t.split()], np.float64) for t in texts]
            width = max(map(len, numbers))
            states = np.stack([np.pad(x, (0, width - len(x)))[:, None] for x in numbers])
            mask = np.stack([np.arange(width) < len(x) for x in numbers])
            return models.masked_mean(states, mask).astype(np.float32)

        return predict

    df = table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.col("embedding").cast("array<string>"), " ").alias("t"))
    return models.encoded(df, "t", make_predict, 1, 64).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("mean"))


@query()
def rf_three_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest's labels of val and test."""
    out = models.three_class(_days(spark, sf_dir).dropna(subset=FEATURES), FEATURES, "target", LABELS)
    return out.filter("split <> 'train'").select("date", "split", "target", "y_pred")


@query()
def gbt_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tomorrow's rate as today's and a boosted change."""
    out, _ = models.boosted_delta(_days(spark, sf_dir).dropna(subset=[*FEATURES, "delta_besok"]), FEATURES, "delta_besok", "kurs_jisdor", rounds=10)
    return out.filter("split <> 'train'").select("date", "split", "kurs_besok", F.round("y_pred", 4).alias("y_pred"))


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature and its share in its family."""
    _, weights = models.boosted_delta(_days(spark, sf_dir).dropna(subset=[*FEATURES, "delta_besok"]), FEATURES, "delta_besok", "kurs_jisdor", rounds=10)
    df = spark.createDataFrame(list(weights.items()), "feature string, importance double")
    family = F.when(F.col("feature").startswith("ret_lag"), "lag").when(F.col("feature").startswith("ret_std"), "volatility").otherwise("return")
    return df.groupBy(family.alias("family")).agg(F.round(F.sum("importance"), 6).alias("importance"))


_SUNK = f"WITH {_PERSIST}, s AS (SELECT *, rate * (1 + pct_change / 100) AS r FROM prd)"


@query(f"{_SUNK} SELECT date, split, 'naive' AS model, target AS y_true_clf, prediction AS y_pred_clf, CAST(target = prediction AS INT) AS correct_clf, rate AS kurs_today, rate_next AS y_true_reg, round(r, 6) AS y_pred_reg, round(r - rate_next, 6) AS err_reg, CAST(sign(rate_next - rate) AS INT) AS dir_true, CAST(sign(r - rate) AS INT) AS dir_pred, CAST(sign(rate_next - rate) = sign(r - rate) AS INT) AS dir_hit FROM s")
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen columns of stored predictions, of yesterday's label and change."""
    df = _persistence(spark, sf_dir).withColumn("r", F.col("rate") * (1 + F.col("pct_change") / 100))
    out = files.predictions(df.select("date", "split", F.col("target").alias("y_true_clf"), F.col("prediction").alias("y_pred_clf"), F.col("rate").alias("kurs_today"), F.col("rate_next").alias("y_true_reg"), F.col("r").alias("y_pred_reg")), "naive")
    return out.withColumn("y_pred_reg", F.round("y_pred_reg", 6))


@query("SELECT tanggal, kurs_jisdor, count(*) AS n FROM jisdor_clean WHERE tanggal <> '' AND kurs_jisdor <> '' GROUP BY 1, 2")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates written as CSV and read again as text."""
    path = new_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "jisdor_clean").filter("tanggal <> '' and kurs_jisdor <> ''"), path)
    return files.read_text_csv(spark, path, ["tanggal", "kurs_jisdor"]).groupBy("tanggal", "kurs_jisdor").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, value FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON and read again with a schema."""
    path = new_folder(spark, "json")
    files.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id bigint, event_type string, value double").json(path)


@query("SELECT article_id, CASE WHEN length(trim(coalesce(body, ''))) >= 300 THEN 'success' ELSE 'failed' END AS page_status, CAST(length(trim(coalesce(body, ''))) AS BIGINT) AS size FROM scrape_article")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and missing bodies are failures, not exceptions."""
    df = files.page_status(table(spark, sf_dir, "scrape_article").select("article_id", "body"), F.col("body"))
    return df.select("article_id", F.col("status").alias("page_status"), F.length(F.trim(F.coalesce("body", F.lit("")))).cast("bigint").alias("size"))


def _escaped(column: str):
    text = F.coalesce(F.col(column), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _page(lines: str = "body") -> Column:
    return F.concat(F.lit("<html><head><title>"), _escaped("title"), F.lit("</title><script>var x = 1;</script></head><body><nav><p>Menu</p></nav><article><p>"), F.replace(_escaped(lines), F.lit("\n"), F.lit("</p><div><p>inner</p></div><p>")), F.lit("</p></article><p>aside</p></body></html>"))


_SHOWN = f"list_filter(list_transform(string_split(replace(coalesce(body, ''), chr(10), chr(10) || 'inner' || chr(10)), chr(10)), lambda x: {_squeezed_sql('x')}), lambda x: x <> '')"


@query(f"SELECT article_id, nullif({_squeezed_sql('title')}, '') AS title, nullif(array_to_string({_SHOWN}, chr(10)), '') AS body FROM scrape_article")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages composed from every title and body, with elements within the article, taken apart again."""
    df = table(spark, sf_dir, "scrape_article")
    return files.extract_pages(df.select("article_id", _page().alias("html")), "article_id", "html").select(F.col("key").alias("article_id"), "title", "body")


_PS = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {_squeezed_sql('x')}), lambda x: x <> '')"
_TEXT = f"CASE WHEN len({_PS}) >= 3 THEN array_to_string(list_filter({_PS}, lambda x, i: list_position({_PS}, x) = i), chr(10)) END"


@query(f"SELECT article_id, nullif(title, '') AS title, nullif(date_published, '') AS published_at, nullif(author, '') AS author, {_TEXT} AS body, CASE WHEN length(coalesce({_TEXT}, '')) >= 300 THEN 'success' ELSE 'failed' END AS status FROM scrape_article")
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with linked data in a second script and a list: metadata, article text and status of each."""
    named = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("date_published").alias("datePublished"), F.array(F.struct(F.col("author").alias("name"))).alias("author")))
    script = F.concat(F.lit('<script type="application/ld+json">{"@type": "WebPage"}</script><script type="application/ld+json">[{"@type": "Thing"}, '), named, F.lit("]</script>"))
    lines = F.replace(_escaped("body"), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<html><head>"), script, F.lit("</head><body><div class='ArticleBody-articleBody'><p>"), lines, F.lit("</p></div></body></html>"))
    out = files.scraped(table(spark, sf_dir, "scrape_article").select("article_id", html.alias("html")), "article_id", "html")
    return out.select(F.col("key").alias("article_id"), "title", "published_at", "author", "body", "status")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def resume_in_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that was cut off after a third and resumed."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    store = new_folder(spark, "resume")
    files.resume(events.filter(F.pmod("event_id", F.lit(3)) == 0), store, "event_id", lambda df: df)
    out = files.resume(events, store, "event_id", lambda df: df)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT tanggal, count(*) AS n, count(try_cast(kurs_jisdor AS DOUBLE)) AS rates FROM jisdor_clean WHERE tanggal <> '' GROUP BY 1")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates written as CSV and read with inferred types, two columns of three."""
    path = new_folder(spark, "csv")
    df = table(spark, sf_dir, "jisdor_clean").filter("tanggal <> ''")
    files.write_csv(df.select("tanggal", F.col("kurs_jisdor").try_cast("double").alias("rate"), F.lit(1).alias("more")), path)
    out = files.read_csv_inferred(spark, path, ["tanggal", "rate"])
    return out.groupBy(F.col("tanggal").cast("string").alias("tanggal")).agg(F.count(F.lit(1)).alias("n"), F.count("rate").alias("rates"))


@query("SELECT event_id, event_type, value FROM events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of records in JSON files, a list a file."""
    path = new_folder(spark, "records")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    lists = events.groupBy(F.pmod("event_id", F.lit(50)).alias("part")).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("value"))
    lists.select("value").repartition(8).write.option("lineSep", "\n").text(path)
    return files.read_json_records(spark, path, "event_id bigint, event_type string, value double", lines=True)


@query("SELECT title_rss, rss_link, published_rss, source, source_url, count(*) AS n FROM (SELECT nullif(trim(regexp_replace(title_rss, '[\\s]+', ' ', 'g')), '') AS title_rss, rss_link, nullif(published_rss, '') AS published_rss, nullif(source, '') AS source, nullif(source_url, '') AS source_url FROM cnbc_discovered) GROUP BY ALL")
def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed hits written as XML items and read again."""
    path = new_folder(spark, "feed")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name}>"))
    source = F.concat(F.lit('<source url="'), _escaped("source_url"), F.lit('">'), _escaped("source"), F.lit("</source>"))
    df = table(spark, sf_dir, "cnbc_discovered").withColumn("title_rss", F.regexp_replace("title_rss", r"\s+", " "))
    item = F.concat(F.lit("<item>"), tag("title", "title_rss"), tag("link", "rss_link"), tag("pubDate", "published_rss"), source, F.lit("</item>"))
    # A feed of at most some hundred hits is one file.
    feeds = df.groupBy(F.floor(F.col("disc_id") / 500).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.write.partitionBy("part").text(path)
    out = files.read_feed_xml(spark, path)
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return out.select(*[blank(c) for c in out.columns]).groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(source) AS word, category FROM documents, (VALUES ('negative', 1), ('positive', 0)) c(category, r) WHERE length(source) % 2 = r")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide dictionary written as CSV and read as words and categories."""
    path = new_folder(spark, "dictionary")
    even = F.length("source") % 2
    files.write_csv(table(spark, sf_dir, "documents").select(F.upper("source").alias("Word"), F.when(even == 1, 2009).otherwise(0).alias("Negative"), F.when(even == 0, 2011).otherwise(0).alias("Positive")).distinct(), path)
    return files.read_dictionary(spark, path, ["Negative", "Positive"])


@query("SELECT 'v' || vec_id AS term, CAST(i AS INT) AS i, round(CAST(x AS DOUBLE), 5) + 0.0::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings WHERE label < 5)")
def vectors_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read for the words that are needed."""
    path = new_folder(spark, "vectors")
    df = table(spark, sf_dir, "embeddings")
    df.select(F.concat(F.lit("v"), "vec_id", F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")).write.text(path)
    needed = df.filter("label < 5").select(F.concat(F.lit("v"), "vec_id").alias("term"))
    return files.read_vectors(spark, path, 64, needed).select("term", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("SELECT 'train' AS name, count(*) AS n FROM daily_kurs_split WHERE split = 'train' UNION ALL SELECT 'val', count(*) FROM daily_kurs_split WHERE split = 'val'")
def stage_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages written as tables, an empty one left out, and read again."""
    folder, days = new_folder(spark, "stages"), _days(spark, sf_dir)
    files.write_stages({"train": days.filter("split = 'train'"), "val": days.filter("split = 'val'"), "none": days.limit(0)}, folder)
    files.require_outputs(spark, [f"{folder}/train", f"{folder}/val"])
    out = None
    for name in ("train", "val"):
        one = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT title_clean AS title, NULL::VARCHAR AS category, CAST(geo_hits AS VARCHAR) AS p_geopolitics, NULL::VARCHAR AS p_rate, left(body_clean, 500) AS text_final FROM articles_aligned")
def preview_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five columns of the preview."""
    df = table(spark, sf_dir, "articles_aligned").select(F.col("title_clean").alias("title"), F.col("geo_hits").cast("string").alias("p_geopolitics"), F.col("body_clean").alias("text_final"))
    return files.preview(df)


@query("SELECT q AS query, CAST(s AS DATE) AS start, 'https://feeds.example/rss/search?q=' || replace(replace(replace(q, '%', '%25'), ' ', '%20'), '&', '%26') || '%20after%3A' || CAST(CAST(s AS DATE) AS VARCHAR) || '%20before%3A' || CAST(least(CAST(s AS DATE) + 7, DATE '2024-03-05') AS VARCHAR) || '&hl=en-US&gl=US&ceid=US:en' AS url FROM range(DATE '2024-01-01', DATE '2024-03-05', INTERVAL 7 DAY) t(s), (SELECT DISTINCT query AS q FROM cnbc_discovered WHERE regexp_full_match(query, '[A-Za-z0-9 &%]*')) WHERE q IS NOT NULL")
def feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of every search window; queries of plain letters, which the SQL can encode."""
    from tidewire.operators import calendar
    from tidewire.sources.web import feed_url

    plain = table(spark, sf_dir, "cnbc_discovered").select("query").distinct().filter(F.col("query").rlike("^[A-Za-z0-9 &%]*$"))
    planned = plain.crossJoin(F.broadcast(calendar.windows(spark, "2024-01-01", "2024-03-05")))
    return planned.select("query", "start", feed_url(F.col("query"), F.col("start"), F.col("end"), "https://feeds.example/rss/search").alias("url"))


@query("SELECT kind, CAST(n AS BIGINT) AS n FROM (VALUES ('read', (SELECT count(*) FROM embeddings)), ('zipped', (SELECT count(*) FROM embeddings))) v(kind, n)")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the binary layout, plain and in a zip file, read back and kept as Parquet."""
    import io
    import zipfile

    folder = new_folder(spark, "packed")
    # A file of vectors is written by its producer; here that is the driver, from a table of a fixed size.
    raw = files.binary_vectors([(f"v{r[0]}", list(r[1])) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").toLocalIterator()])
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        out.writestr("v.bin", raw)
    spark.createDataFrame([("read", bytearray(raw)), ("zipped", bytearray(packed.getvalue()))], "kind string, content binary").write.parquet(folder)
    rows = files.unpacked_vectors(spark.read.parquet(folder), 64, keep="kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark: SparkSession, sf_dir: str, late: int = 0) -> DataFrame:
    """Events in files in order of time, then ``late`` events of the first hour again, then an end mark a year later without a value."""
    folder = new_folder(spark, "stream-in")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    parts = cut(events.repartitionByRange(4, "ts").withColumn("_part", F.spark_partition_id()), "parts")
    end = events.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"), F.lit(None).cast("double").alias("value"))
    # Files are read in the order in which they were written, so each step is written after the one before.
    for i in range(4):
        parts.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    if late:
        first = events.agg(F.min("ts").alias("first"))
        events.crossJoin(F.broadcast(first)).filter(F.col("ts") < F.col("first") + F.expr("interval 1 hour")).drop("first").coalesce(1).write.mode("append").parquet(folder)
    end.coalesce(1).write.mode("append").parquet(folder)
    return news.stream_table(spark, folder, "event_id bigint, ts timestamp_ntz, user_id bigint, value double", 1)


def _run(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = new_folder(spark, "stream-out")
    news.run_to_table(df, out, new_folder(spark, "stream-state"))
    return spark.read.parquet(out)


@query(f"WITH {_ALIGNED} SELECT trading_date, count(*) AS n_articles, round(avg(value), 6) AS score_mean FROM al GROUP BY 1")
def stream_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per trading day from a stream joined to the calendar, in append mode; equal to the batch result, and late events change nothing."""
    days = cut(_calendar(spark), "calendar")
    out = news.trading_days(_run(spark, news.per_trading_day(_event_stream(spark, sf_dir, late=1), days, "ts", "value", "1 day")).filter("n_articles > 0"))
    return out.select("trading_date", "n_articles", F.round("score_mean", 6).alias("score_mean"))


@query("SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over tumbling weeks from a stream in append mode; late events change nothing."""
    out = _run(spark, news.windowed(_event_stream(spark, sf_dir, late=1), "ts", "value", lateness="1 day")).filter("n > 0")
    return out.select(F.to_date("start").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT user_id, 1::BIGINT AS n FROM events GROUP BY 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user within the watermark of a stream, and how often it came out, which is once."""
    out = _run(spark, news.first_seen(_event_stream(spark, sf_dir, late=1), "user_id", "ts", "60 days").select("user_id", "event_id"))
    return out.filter("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
