"""Queries of whole articles, daily feature tables and small relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import contracts
from tidewire.functions import text as t
from tidewire.operators import articles, features, joins, metrics, series
from tidewire.plans.series_queries import _CLASSES, _PERSIST, _SPLIT, LABELS, _days, _persistence, _rates, _RATES, _split
from tidewire.plans.text_queries import _BOW, _LEX, _S, _TERMS, LEXICON, _bags, _classical_sql, _hits_sql, _lexicon, light_sql
from tidewire.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _strip_sql(text: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({text}, '^[{_S}]+', ''), '[{_S}]+$', ''), '')"


_REQUIRED = ("author", "title", "date_published", "body", "discovery_title", "url")
_COMPLETE = " AND ".join(f"{_strip_sql(c)} IS NOT NULL" for c in _REQUIRED)


def _field_sql(column: str) -> str:
    return f"replace(array_to_string({_hits_sql(t.keyword_terms(), f'''coalesce({column}, '')''')}, '|'), '  ', ' ')"


def _shown(df: DataFrame) -> DataFrame:
    m = "geopolitical_matches"
    return df.select("article_id", *[F.array_join(f"{m}.{c}", "|").alias(f"in_{c}") for c in ("title", "body", "discovery_title")])


_MATCHED = ", ".join(f"{_field_sql(c)} AS in_{c}" for c in ("title", "body", "discovery_title"))


@query(f"SELECT article_id, {_MATCHED} FROM scrape_article WHERE in_title <> '' OR in_body <> '' OR in_discovery_title <> ''")
def field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each field of a page, for pages with any."""
    return _shown(articles.with_matches(table(spark, sf_dir, "scrape_article")))


@query(f"SELECT article_id, {_MATCHED} FROM scrape_article WHERE {_COMPLETE} AND (in_title <> '' OR in_body <> '' OR in_discovery_title <> '')")
def filter_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete pages with a keyword."""
    return _shown(articles.filter_news(table(spark, sf_dir, "scrape_article"), _REQUIRED))


_ASSEMBLED = f"coalesce(nullif(concat_ws(chr(10) || chr(10), {_strip_sql('title')}, {_strip_sql('body')}), ''), {_strip_sql('discovery_title')}, '')"


@query(f"SELECT article_id, {_ASSEMBLED} AS text FROM scrape_article")
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body, or the feed's title if both are blank."""
    df = table(spark, sf_dir, "scrape_article")
    return df.select("article_id", articles.assembled(df).alias("text"))


@query(f"WITH RECURSIVE {light_sql('SELECT aligned_id AS id, title_clean AS body FROM articles_aligned')}, c AS (SELECT id, light, {_classical_sql('light')} AS ws FROM light) SELECT id AS aligned_id, light AS text_clean_light, array_to_string(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]), ' ') AS text_clean_classical FROM c")
def preprocessed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles through the whole of light and classical cleaning."""
    df = articles.preprocess_documents(table(spark, sf_dir, "articles_aligned").select("aligned_id", "title_clean"), "title_clean")
    return df.select("aligned_id", "text_clean_light", "text_clean_classical")


@query(f"WITH RECURSIVE {light_sql('SELECT aligned_id AS id, body_clean AS body FROM articles_aligned')}, c AS (SELECT id, {_classical_sql('light')} AS ws FROM light) SELECT id AS aligned_id, len(ws) AS n, array_to_string(ws, ' ') AS unigrams, array_to_string(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || '_' || ws[i + 1] || '_' || ws[i + 2]), ' ') AS trigrams FROM c")
def classical_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as lemmas after light cleaning, with runs of three."""
    df = articles.preprocess_documents(table(spark, sf_dir, "articles_aligned").select("aligned_id", F.col("body_clean").alias("body")))
    df = df.withColumn("trigrams", F.array_join(t.ngrams(F.col("unigrams"), 3), " "))
    return df.select("aligned_id", F.size("unigrams").cast("bigint").alias("n"), F.array_join("unigrams", " ").alias("unigrams"), "trigrams")


_INNER = r"\p{L}\p{M}\p{Nd}\x{200c}\x{200d}"


@query(f"SELECT aligned_id, array_to_string(regexp_extract_all(lower(body_clean), '[{_INNER}]+(?:''[{_INNER}]+)?', 0), ' ') AS tokens FROM articles_aligned")
def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of any script, for embeddings."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", F.array_join(t.embedding_tokens(F.col("body_clean")), " ").alias("tokens"))


@query(f"SELECT article_id, coalesce(nullif(concat_ws(' [SEP] ', {_strip_sql('title')}, {_strip_sql('body')}), ''), '') AS both, coalesce({_strip_sql('title')}, '') AS title FROM scrape_article")
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body with a separator, and the title alone."""
    title, body = F.col("title"), F.col("body")
    return table(spark, sf_dir, "scrape_article").select("article_id", articles.composed_text(title, body).alias("both"), articles.composed_text(title, body, "title").alias("title"))


@query("SELECT disc_id, nfc_normalize(title_rss) AS title FROM cnbc_discovered")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines in canonical composition."""
    return table(spark, sf_dir, "cnbc_discovered").select("disc_id", t.normal_form(F.col("title_rss")).alias("title"))


@query("SELECT article_id, body FROM scrape_article")
def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies escaped and unescaped again."""
    escaped = F.col("body")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("é", "&eacute;"), ("—", "&#8212;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    return table(spark, sf_dir, "scrape_article").select("article_id", t.unescaped(escaped).alias("body"))


@query(f"SELECT disc_id, regexp_replace(regexp_replace(title_rss, '{t.INVISIBLE}', '', 'g'), '{t.CONTROL}', ' ', 'g') AS title FROM cnbc_discovered".replace(r"\x7f-\x9f", r"\x7f-\x{9f}"))
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines without invisible characters and controls."""
    return table(spark, sf_dir, "cnbc_discovered").select("disc_id", F.regexp_replace(F.regexp_replace("title_rss", t.INVISIBLE, ""), t.CONTROL, " ").alias("title"))


@query(f"SELECT aligned_id, i, p FROM (SELECT aligned_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT aligned_id, list_filter(list_transform(string_split_regex(body_clean, '\\n+'), lambda x: coalesce({_strip_sql('x')}, '')), lambda x: x <> '') AS ps FROM articles_aligned))")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paragraph that isn't blank."""
    parts = F.filter(F.transform(F.split("body_clean", "\n+"), articles.stripped), lambda p: p.isNotNull())
    rows = table(spark, sf_dir, "articles_aligned").select("aligned_id", F.posexplode(parts).alias("i", "p"))
    return rows.select("aligned_id", (F.col("i") + 1).cast("bigint").alias("i"), "p")


# --- daily features

_VAL = "val(word, x) AS (SELECT word, CASE category WHEN 'negative' THEN -2.0::DOUBLE WHEN 'positive' THEN 2.0::DOUBLE ELSE -0.5::DOUBLE END FROM lex)"


def _compound_sql(name: str, source: str) -> str:
    """``name (aligned_id, c)`` of ``source (aligned_id, i, s)``."""
    return f"""{name}w AS (SELECT aligned_id, i, unnest(regexp_extract_all(lower(s), '[a-z]{{2,}}', 0)) AS word FROM {source}), {name}v AS (SELECT aligned_id, i, sum(x) AS v FROM {name}w JOIN val USING (word) GROUP BY 1, 2),
{name} AS (SELECT aligned_id, coalesce(v / sqrt(v * v + 15), 0) AS c FROM {source} LEFT JOIN {name}v USING (aligned_id, i))"""


_SENTENCES = f"list_filter(string_split_regex(regexp_replace(body_clean, '([.!?])[{_S}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: len(list_filter(string_split_regex(s, '[{_S}]+'), lambda w: w <> '')) >= 3)"
_SCORES = f"""{_LEX}, {_VAL}, art AS (SELECT aligned_id, any_value(title_clean) AS title_clean, any_value(body_clean) AS body_clean, any_value(n_words) AS n_words, any_value(news_date_wib) AS day FROM articles_aligned GROUP BY 1),
tt AS (SELECT aligned_id, 0 AS i, coalesce(title_clean, '') AS s FROM art), bb AS (SELECT aligned_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT aligned_id, {_SENTENCES} AS ss FROM art)),
{_compound_sql('ct', 'tt')}, {_compound_sql('cb', 'bb')}, ba AS (SELECT aligned_id, avg(c) AS m, avg(CAST(c <= -0.05 AS INT)) AS neg FROM cb GROUP BY 1),
tok AS (SELECT aligned_id, unnest({_BOW}) AS term FROM art), hit AS (SELECT aligned_id, category, count(*) AS n FROM tok JOIN lex ON term = word GROUP BY 1, 2),
shr AS (SELECT a.aligned_id, day, {", ".join(f"coalesce(sum(n) FILTER (category = '{c}'), 0) / greatest(any_value(n_words), 1)::DOUBLE AS lm_{c}" for c in LEXICON)} FROM art a LEFT JOIN hit USING (aligned_id) GROUP BY 1, 2),
sco AS (SELECT shr.*, lm_positive - lm_negative AS lm_net, ct.c AS valence_title, coalesce(m, 0) AS valence_body, coalesce(neg, 0) AS valence_neg_share FROM shr JOIN ct USING (aligned_id) LEFT JOIN ba USING (aligned_id))"""
_MEASURES = ("valence_title", "valence_body", "valence_neg_share", *[f"lm_{c}" for c in LEXICON], "lm_net")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "articles_aligned").dropDuplicates(["aligned_id"]).withColumn("body_bow", t.bag_of_words(F.col("body_clean")))
    lexicon = _lexicon(spark)
    valences = lexicon.select("word", F.when(F.col("category") == "negative", -2.0).when(F.col("category") == "positive", 2.0).otherwise(-0.5).alias("valence"))
    scores = articles.article_scores(df, F.broadcast(lexicon), F.broadcast(valences), "aligned_id", tuple(LEXICON))
    return scores.join(df.select("aligned_id", F.col("news_date_wib").alias("day")), "aligned_id")


@query(f"WITH {_SCORES} SELECT aligned_id, {', '.join(f'round({c}, 8) AS {c}' for c in _MEASURES)} FROM sco")
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valence of title and sentences and shares of lexicon categories of every article."""
    return _scores(spark, sf_dir).select("aligned_id", *[F.round(c, 8).alias(c) for c in _MEASURES])


_DAILY = [f"{c}_mean" for c in _MEASURES if c != "valence_neg_share"] + ["valence_body_min", "valence_neg_share"]
_AGG = ", ".join([*[f"avg({c}) AS {c}_mean" for c in _MEASURES if c != "valence_neg_share"], "min(valence_body) AS valence_body_min", "avg(valence_neg_share) AS valence_neg_share"])


@query(f"""WITH {_SCORES}, agg AS (SELECT try_cast(day AS DATE) AS news_date, count(*) AS n_articles, {_AGG} FROM sco GROUP BY 1),
nxt AS (SELECT date, split, lead(date) OVER (ORDER BY date) AS news_date, lead(split) OVER (ORDER BY date) AS nx FROM daily_kurs_split)
SELECT date, split, coalesce(n_articles, 0) AS n_articles, CAST(n_articles IS NULL AS INT) AS no_news, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in _DAILY)} FROM nxt LEFT JOIN agg USING (news_date) WHERE nx = split""")
def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table: every day with the next window's news, zeros and a flag where there is none."""
    scores = _scores(spark, sf_dir).withColumn("day", F.try_to_date("day", "yyyy-MM-dd"))
    out = articles.daily_features(scores, _days(spark, sf_dir).select("date", "split"), "day")
    return out.select("date", "split", "n_articles", "no_news", *[F.round(c, 6).alias(c) for c in _DAILY])


@query(f"WITH {_TERMS}, {_LEX}, h AS (SELECT split, aligned_id, category, count(*) AS n FROM tok JOIN lex ON term = word GROUP BY 1, 2, 3), s AS (SELECT split, aligned_id, category, n / sum(n) OVER (PARTITION BY aligned_id, split) AS share FROM h), k AS (SELECT split, count(DISTINCT aligned_id) AS k FROM s GROUP BY 1) SELECT category AS topic, {', '.join(f'''round(coalesce(sum(share) FILTER (split = '{s}') / max(k) FILTER (split = '{s}'), 0), 6) AS {s}''' for s in ('train', 'val', 'test'))} FROM s JOIN k USING (split) GROUP BY 1")
def topic_split_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of each topic per split, topics as rows; lexicon categories stand for topics."""
    words = _bags(spark, sf_dir).select("split", "aligned_id", F.explode("tokens").alias("word")).join(F.broadcast(_lexicon(spark)), "word")
    wide = words.groupBy("split", "aligned_id").pivot("category", list(LEXICON)).count().fillna(0)
    total = sum((F.col(c) for c in LEXICON), F.lit(0))
    return features.topic_means(wide.select("split", *[(F.col(c) / total).alias(c) for c in LEXICON]), tuple(LEXICON)).select("topic", *[F.round(s, 6).alias(s) for s in ("train", "val", "test")])


@query(f"WITH {_TERMS}, " + ", ".join(f"v{s} AS (SELECT term, count(*) AS total FROM tok WHERE split = '{s}' GROUP BY 1)" for s in ("train", "val", "test")) + " SELECT term, total FROM vtrain WHERE term IN (SELECT term FROM vval) AND term IN (SELECT term FROM vtest) ORDER BY total DESC, term LIMIT 400")
def shared_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 most frequent terms of train that all splits have."""
    tokens = _bags(spark, sf_dir).select("split", F.explode("tokens").alias("term")).groupBy("split", "term").agg(F.count(F.lit(1)).alias("total"))
    return features.shared_terms([tokens.filter(F.col("split") == s).select("term", "total") for s in ("train", "val", "test")], 400)


# --- relational

@query(f"WITH {_PERSIST}, {_CLASSES}, p AS (SELECT split, 'persistence' AS model, sum(hit) / sum(support) AS accuracy FROM sc GROUP BY 1), g AS (SELECT target AS m FROM spl WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), q AS (SELECT split, 'majority' AS model, avg(CAST(target = m AS INT)) AS accuracy FROM spl, g WHERE split IS NOT NULL GROUP BY 1), u AS (SELECT * FROM p UNION ALL SELECT * FROM q) SELECT model, {', '.join(f'''round(max(accuracy) FILTER (split = '{s}'), 6) AS {s}''' for s in ('train', 'val', 'test'))} FROM u GROUP BY 1")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two models, a row each, splits as columns."""
    long = _comparison(spark, sf_dir).filter("task = 'clf'")
    out = metrics.pivoted(long, "model", "split", "accuracy", ("train", "val", "test"))
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("train", "val", "test")])


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of naive models of both tasks."""
    days = _split(spark, sf_dir)
    clf = {}
    for name, df in (("persistence", _persistence(spark, sf_dir)), ("majority", series.majority(days))):
        clf[name] = metrics.classification(metrics.confusion(df, "target", "prediction", LABELS, ("split",)), ("split",)).withColumn("task", F.lit("clf"))
    reg = {"random walk": metrics.regression(days, "rate_next", "rate", "rate", ("split",)).withColumn("task", F.lit("reg"))}
    return joins.tagged_union(clf | reg, "model")


@query(f"WITH {_PERSIST}, {_CLASSES}, c AS (SELECT split, 'persistence' AS model, 'clf' AS task, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM sc GROUP BY 1), r AS (SELECT split, 'random walk' AS model, 'reg' AS task, round(sqrt(avg(power(rate - rate_next, 2))), 6) AS rmse FROM spl WHERE split IS NOT NULL GROUP BY 1) SELECT model, split, task, accuracy, macro_f1, NULL::DOUBLE AS rmse FROM c UNION ALL SELECT model, split, task, NULL, NULL, rmse FROM r")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of metrics that share no column on top of each other."""
    out = _comparison(spark, sf_dir).filter("model <> 'majority'")
    return out.select("model", "split", "task", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "rmse")])


@query("SELECT split, date, target FROM daily_kurs_split WHERE split = 'val' UNION ALL SELECT split, date, target FROM daily_kurs_split WHERE split = 'test'")
def row_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Val and test on top of each other."""
    days = _days(spark, sf_dir).select("split", "date", "target")
    return days.filter("split = 'val'").unionByName(days.filter("split = 'test'"))


@query("SELECT split, date, delta_besok, kurs_besok - kurs_jisdor AS delta, CASE WHEN kurs_besok IS NULL THEN NULL WHEN (kurs_besok / kurs_jisdor - 1) * 100 > 0.1 THEN 'NAIK' WHEN (kurs_besok / kurs_jisdor - 1) * 100 < -0.1 THEN 'TURUN' ELSE 'STABIL' END AS target FROM daily_kurs_split")
def recomputed_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label from tomorrow's rate where the table has none."""
    df = series.with_target(_days(spark, sf_dir).drop("target"), "kurs_jisdor", "kurs_besok")
    return df.select("split", "date", "delta_besok", F.col("delta"), "target")


@query(f"WITH {_RATES}, a AS (SELECT try_cast(news_date_wib AS DATE) AS date, count(*) AS n FROM articles_aligned GROUP BY 1) SELECT date, CAST(isodow(date) - 1 AS INT) AS dayofweek, CAST(coalesce(n, 0) > 0 AS INT) AS has_news, coalesce(n, 0) AS n_articles FROM rates LEFT JOIN a USING (date)")
def legacy_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday and whether there is news, per day of the rates."""
    news = table(spark, sf_dir, "articles_aligned").groupBy(F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n_articles")).filter("date is not null")
    days = joins.onto_spine(_rates(spark, sf_dir).select("date"), news, ["date"], {"n_articles": 0})
    return days.select("date", F.weekday("date").alias("dayofweek"), (F.col("n_articles") > 0).cast("int").alias("has_news"), "n_articles")


@query("SELECT a.aligned_id, a.split, k.kurs_jisdor AS rate FROM articles_aligned a JOIN daily_kurs_split k ON k.date = try_cast(a.news_date_wib AS DATE)")
def many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the rate of their day; days are unique or it is an error."""
    left = table(spark, sf_dir, "articles_aligned").select("aligned_id", "split", F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date")).filter("date is not null")
    return contracts.join_many_to_one(left, _days(spark, sf_dir).select("date", F.col("kurs_jisdor").alias("rate")), ["date"]).select("aligned_id", "split", "rate")


@query("SELECT date, split, kurs_jisdor, coalesce(n, 0) AS n FROM daily_kurs_split k LEFT JOIN (SELECT try_cast(news_date_wib AS DATE) AS d, split AS s, count(*) AS n FROM articles_aligned GROUP BY 1, 2) ON d = date AND s = split")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with features of the same day and split; both sides unique, no null after filling."""
    news = table(spark, sf_dir, "articles_aligned").groupBy(F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date"), "split").agg(F.count(F.lit(1)).alias("n")).filter("date is not null and split is not null")
    out = contracts.join_one_to_one(_days(spark, sf_dir).select("date", "split", "kurs_jisdor"), news, ["date", "split"]).fillna(0, ["n"])
    return contracts.require_no_nulls(out, "n")


@query("SELECT date, coalesce(v1, 0.0::DOUBLE) AS emb_1, coalesce(v2, 0.0::DOUBLE) AS emb_2 FROM daily_kurs_split LEFT JOIN (SELECT try_cast(news_date_wib AS DATE) AS date, CAST(count(*) AS DOUBLE) AS v1, CAST(sum(n_words) AS DOUBLE) AS v2 FROM articles_aligned GROUP BY 1) USING (date)")
def numbered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature columns of any names joined by day as emb_1, emb_2, .."""
    news = table(spark, sf_dir, "articles_aligned").groupBy(F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("some"), F.sum("n_words").alias("other"))
    return joins.numbered_features(_days(spark, sf_dir).select("date"), news.filter("date is not null"), "date")


@query("SELECT article_id, coalesce(a.title, d.t) AS title, coalesce(a.date_published, d.p) AS date_published, d.s AS source FROM scrape_article a LEFT JOIN (SELECT rss_link, min(title_rss) AS t, min(published_rss) AS p, min(source) AS s FROM cnbc_discovered GROUP BY 1) d USING (rss_link)")
def suffix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose repeated columns fill nulls of the left side."""
    feed = table(spark, sf_dir, "cnbc_discovered").groupBy("rss_link").agg(F.min("title_rss").alias("title"), F.min("published_rss").alias("date_published"), F.min("source").alias("source"))
    pages = table(spark, sf_dir, "scrape_article").select("article_id", "rss_link", "title", "date_published")
    return joins.repaired(pages, feed, ["rss_link"]).select("article_id", "title", "date_published", "source")


@query(f"WITH {_RATES} SELECT date, rate, row_number() OVER (ORDER BY date) AS place FROM rates")
def chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates sorted by day, with their place."""
    from pyspark.sql import Window

    return _rates(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy("date")).cast("bigint")).orderBy("date")


@query("SELECT article_id, url FROM scrape_article WHERE url IS NOT NULL ORDER BY article_id LIMIT 100")
def max_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of a load that is limited on purpose."""
    return table(spark, sf_dir, "scrape_article").filter("url is not null").orderBy("article_id").limit(100).select("article_id", "url")


@query("SELECT article_id, error FROM scrape_article WHERE status = 'failed' ORDER BY md5('42:' || article_id), article_id LIMIT 10")
def reject_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rejected pages for a look, the same ones every time."""
    return joins.seeded_sample(table(spark, sf_dir, "scrape_article").filter("status = 'failed'"), "article_id", 10).select("article_id", "error")


_ORDER = ("test", "val", "train")


@query("SELECT split, target, count(*) AS n, row_number() OVER (ORDER BY list_position(['test', 'val', 'train'], split), target) AS place FROM daily_kurs_split WHERE target IS NOT NULL GROUP BY 1, 2")
def ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts sorted by the place of the split in a list."""
    from pyspark.sql import Window

    counts = _days(spark, sf_dir).filter("target is not null").groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.array_position(F.array(*[F.lit(x) for x in _ORDER]), F.col("split")), "target"))
    return joins.in_order(counts.withColumn("place", place.cast("bigint")), "split", _ORDER, "target")


@query(f"WITH {_SPLIT}, e AS (SELECT split, date, rate - rate_next AS residual, abs(rate - rate_next) AS size FROM spl WHERE split IN ('val', 'test')) SELECT split, date, CAST(residual AS DOUBLE) AS residual, round(avg(size) OVER (PARTITION BY split ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS running_mae FROM e")
def residual_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the residual chart shows: errors of the random walk and their running mean."""
    from pyspark.sql import Window

    df = _split(spark, sf_dir).filter("split in ('val', 'test')").withColumn("residual", (F.col("rate") - F.col("rate_next")).cast("double"))
    w = Window.partitionBy("split").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("split", "date", "residual", F.round(F.avg(F.abs("residual")).over(w), 6).alias("running_mae"))


@query("SELECT split, target, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM daily_kurs_split WHERE target IS NOT NULL GROUP BY 1, 2")
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per split in percent."""
    from pyspark.sql import Window

    counts = _days(spark, sf_dir).filter("target is not null").groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 6))


@query("SELECT date, round(1 / (1 + exp(-least(greatest(ret_lag1 * 1000, -30), 30))), 8) AS p FROM daily_kurs_split WHERE ret_lag1 IS NOT NULL")
def clipped_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic values with the argument clipped."""
    return _days(spark, sf_dir).filter("ret_lag1 is not null").select("date", F.round(features.sigmoid(F.col("ret_lag1") * 1000), 8).alias("p"))


_FUSED = """
grid AS (SELECT i, i / 20.0::DOUBLE AS w FROM range(0, 21) t(i)),
sub AS (SELECT date, split, target, kurs_jisdor AS today, kurs_besok AS truth, 1 / (1 + exp(-200 * ret_lag1)) AS a1, 0.3::DOUBLE AS a2, 1 / (1 + exp(200 * ret_lag1)) AS a3, 1 / (1 + exp(-200 * log_return)) AS b1, 0.5::DOUBLE AS b2, 1 / (1 + exp(200 * log_return)) AS b3,
  kurs_jisdor * (1 + ret_lag1) AS ra, kurs_jisdor * (1 - log_return / 2) AS rb FROM daily_kurs_split WHERE target IS NOT NULL AND kurs_besok IS NOT NULL AND ret_lag1 IS NOT NULL AND log_return IS NOT NULL AND split IN ('val', 'test')),
mix AS (SELECT i, w, split, target, truth, today, w * a1 + (1 - w) * b1 AS s1, w * a2 + (1 - w) * b2 AS s2, w * a3 + (1 - w) * b3 AS s3, w * ra + (1 - w) * rb AS r FROM sub, grid),
prd AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'NAIK' WHEN s2 >= s3 THEN 'STABIL' ELSE 'TURUN' END AS pred FROM mix),
lbl AS (SELECT unnest(['NAIK', 'STABIL', 'TURUN']) AS l),
f1s AS (SELECT split, i, w, l, coalesce(2.0::DOUBLE * count(*) FILTER (target = l AND pred = l) / nullif(count(*) FILTER (target = l) + count(*) FILTER (pred = l), 0), 0) AS f1 FROM prd, lbl GROUP BY 1, 2, 3, 4),
mf AS (SELECT split, i, w, round(avg(f1), 9) AS macro_f1 FROM f1s GROUP BY 1, 2, 3), rm AS (SELECT split, i, w, round(sqrt(avg(power(r - truth, 2))), 9) AS rmse FROM prd GROUP BY 1, 2, 3),
wc AS (SELECT w AS w_clf FROM mf WHERE split = 'val' ORDER BY macro_f1 DESC, i DESC LIMIT 1), wr AS (SELECT w AS w_reg FROM rm WHERE split = 'val' ORDER BY rmse, i DESC LIMIT 1)
"""


@query(f"WITH {_FUSED} SELECT mf.split, round(w_clf, 2) AS w_clf, round(w_reg, 2) AS w_reg, round(macro_f1, 6) AS macro_f1, round(rmse, 6) AS rmse FROM wc, wr, mf JOIN rm USING (split) WHERE mf.w = w_clf AND rm.w = w_reg")
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' outputs mixed with the weights that were best on val, from the largest weight down."""
    days = _days(spark, sf_dir).dropna(subset=["target", "kurs_besok", "ret_lag1", "log_return"]).filter("split in ('val', 'test')")
    p = lambda c, s: 1 / (1 + F.exp(s * 200 * F.col(c)))
    rows = days.select(
        "split", "target", F.col("kurs_besok").alias("truth"), p("ret_lag1", -1).alias("a1"), F.lit(0.3).alias("a2"), p("ret_lag1", 1).alias("a3"), p("log_return", -1).alias("b1"), F.lit(0.5).alias("b2"), p("log_return", 1).alias("b3"),
        (F.col("kurs_jisdor") * (1 + F.col("ret_lag1"))).alias("ra"), (F.col("kurs_jisdor") * (1 - F.col("log_return") / 2)).alias("rb"),
    )
    grid = metrics.late_fusion(rows, "split", "target", ("a1", "a2", "a3"), ("b1", "b2", "b3"), "truth", "ra", "rb", LABELS)
    return grid.select("split", F.round("w_clf", 2).alias("w_clf"), F.round("w_reg", 2).alias("w_reg"), F.round("macro_f1", 6).alias("macro_f1"), F.round("rmse", 6).alias("rmse"))
