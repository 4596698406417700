"""Articles: what they say, whether they matter, and one row of features per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.contracts import require_columns
from tidewire.functions import text as t
from tidewire.operators import features, joins, series

#: Fields an article must have.
REQUIRED = ("author", "title", "published_at", "body", "discovery_title", "url")
#: Fields that make up an article's text, and those that stand in if all are blank.
PARTS, FALLBACKS = ("title", "heading", "body"), ("text", "content", "discovery_title")


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def with_required(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows in which every required field is neither null nor blank."""
    require_columns(df, *required)
    keep = F.lit(True)
    for c in required:
        keep = keep & stripped(F.col(c).cast("string")).isNotNull()
    return df.filter(keep)


def with_matches(df: DataFrame) -> DataFrame:
    """Adds ``geopolitical_matches``, the distinct keywords of each field in first-seen order, and keeps rows with any."""
    require_columns(df, "title", "body", "discovery_title")
    matched = df.withColumn("geopolitical_matches", t.field_matches(F.col("title"), F.col("body"), F.col("discovery_title")))
    m = "geopolitical_matches"
    return matched.filter((F.size(f"{m}.title") > 0) | (F.size(f"{m}.body") > 0) | (F.size(f"{m}.discovery_title") > 0))


def filter_news(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Complete rows that hold a keyword."""
    return with_matches(with_required(df, required))


def assembled(df: DataFrame) -> Column:
    """Title, heading and body that aren't blank, or else what stands in for them, apart by an empty line."""
    of = lambda names: F.concat_ws("\n\n", *[stripped(F.col(c)) for c in names if c in df.columns])
    return F.coalesce(F.nullif(of(PARTS), F.lit("")), of(FALLBACKS))


def preprocessed(df: DataFrame, text: Column | None = None, least: int = 3, with_bigrams: bool = True, similar: float = 0.8) -> DataFrame:
    """Adds ``text_clean_light, text_clean_classical, tokens_classical, unigrams, bigrams, text_final, preserved_entities``.

    The text is the assembled article, unless another is given. Null and blank
    texts have empty results.
    """
    step = df.withColumn("_raw", F.coalesce(assembled(df) if text is None else text, F.lit("")))
    step = step.withColumn("text_clean_light", t.light_clean(F.col("_raw"), similar=similar))
    step = step.withColumn("unigrams", t.classical_tokens(F.col("text_clean_light"), least))
    step = step.withColumn("bigrams", t.bigrams(F.col("unigrams")) if with_bigrams else F.array().cast("array<string>"))
    step = step.withColumn("tokens_classical", F.concat("unigrams", "bigrams"))
    entities = F.struct(t.entities(F.col("_raw")).alias("capitalized_candidates"), t.numbers(F.col("_raw")).alias("numbers"))
    return step.withColumns({"text_clean_classical": F.array_join("tokens_classical", " "), "text_final": F.col("text_clean_light"), "preserved_entities": entities}).drop("_raw")


def preprocess_documents(df: DataFrame, column: str | None = None, **options) -> DataFrame:
    """:func:`preprocessed` of one column: the named one, else body, else text, else the first."""
    column = column or next((c for c in ("body", "text") if c in df.columns), df.columns[0])
    return preprocessed(df, F.col(column).cast("string"), **options)


def composed_text(title: Column, body: Column, mode: str = "both", separator: str = " [SEP] ") -> Column:
    """Title, body, or both with a separator if neither is blank."""
    if mode not in ("title", "body", "both"):
        raise ValueError("mode is title, body or both")
    a, b = stripped(title), stripped(body)
    return F.coalesce({"title": a, "body": b, "both": F.concat_ws(separator, a, b)}[mode], F.lit(""))


def text_columns(df: DataFrame) -> tuple[str, str]:
    """The first pair of title and body columns that the table has."""
    for pair in (("title_bow", "body_bow"), ("title_clean", "body_clean"), ("title", "body")):
        if all(c in df.columns for c in pair):
            return pair
    raise ValueError("no pair of title and body columns")


def clean_articles(df: DataFrame, key: str, first: str, last: str, suffix: str = "[A-Za-z]+") -> dict[str, DataFrame]:
    """The stages of cleaning, in order: ``status, period, clean, noise, geo, length, unique``.

    ``df`` has ``key, url, title, published_at (timestamp), body, status``.
    Later stages see what earlier ones left; quantiles of length are taken of
    the rows that passed the stages before. Of equal urls, titles of a day and
    bodies the earliest stays.
    """
    stages: dict[str, DataFrame] = {}
    df = stages["status"] = df.filter((F.col("status") == "success") & stripped(F.col("body")).isNotNull())
    local = F.from_utc_timestamp("published_at", "Asia/Jakarta")
    df = df.withColumn("published_wib", local).filter((F.col("published_wib") >= F.lit(first).cast("timestamp")) & (F.col("published_wib") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")))
    df = stages["period"] = df.withColumn("news_date_wib", F.date_format("published_wib", "yyyy-MM-dd"))
    df = df.withColumn("title_clean", t.clean_title(t.composed(F.coalesce("title", F.lit("")), "NFKC"), suffix)).withColumn("body_clean", t.clean_paragraphs(t.composed(F.col("body"), "NFKC")))
    df = stages["clean"] = df.withColumn("n_words", t.word_count(F.col("body_clean"))).filter("body_clean <> ''")
    df = stages["noise"] = df.filter(~F.col("title_clean").rlike("(?i)" + "|".join(t.NOISE_TITLES)))
    both = F.concat_ws(" ", "title_clean", "body_clean")
    df = df.withColumn("_th", F.size(t.term_hits(F.col("title_clean"), t.GEO_TERMS))).withColumn("geo_hits", F.size(t.term_hits(both, t.GEO_TERMS)))
    df = stages["geo"] = df.filter("_th >= 1 or geo_hits >= 2").drop("_th")
    q = df.agg(F.percentile("n_words", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    df = stages["length"] = df.crossJoin(F.broadcast(q)).filter("n_words >= 100 and n_words <= _q[1] + 3 * (_q[1] - _q[0])").drop("_q")
    keyed = df.withColumn("_u", t.normal_url(F.col("url"))).withColumn("_t", t.text_key(F.col("title_clean"))).withColumn("_b", F.md5(t.text_key(F.col("body_clean"))))
    kept = joins.keep_first_in_turn(keyed, [["_u"], ["_t", "news_date_wib"], ["_b"]], ["published_at", key]).drop("_u", "_t", "_b")
    stages["unique"] = kept.withColumn("title_bow", t.bag_of_words(F.col("title_clean"))).withColumn("body_bow", t.bag_of_words(F.col("body_clean")))
    return stages


def article_scores(df: DataFrame, lexicon: DataFrame, valences: DataFrame, key: str, categories: tuple[str, ...], title: str = "title_clean", body: str = "body_clean", bow: str = "body_bow", words: str = "n_words") -> DataFrame:
    """``key, valence_title, valence_body, valence_neg_share, lm_<category>.., lm_net`` of every article.

    The body's valence is the mean over its sentences of three words and more,
    with the share of sentences at or below -0.05; zeros if there are none.
    """
    plain = df.select(key, F.coalesce(title, F.lit("")).alias("_t"), F.coalesce(body, F.lit("")).alias("_b"), F.filter(F.split(F.coalesce(bow, F.lit("")), " "), lambda w: w != "").alias("_w"), F.col(words).alias("_n"))
    of_title = features.sentence_valence(plain.select(key, F.array("_t").alias("s")), valences, key, "s").select(key, F.col("mean").alias("valence_title"))
    of_body = features.sentence_valence(plain.select(key, t.sentences(F.col("_b")).alias("s")), valences, key, "s").select(key, F.col("mean").alias("valence_body"), F.col("neg_share").alias("valence_neg_share"))
    shares = features.lexicon_scores(plain, lexicon, key, "_w", "_n", categories)
    shares = shares.select(key, *[F.col(c).alias(f"lm_{c}") for c in categories])
    if {"positive", "negative"} <= set(categories):
        shares = shares.withColumn("lm_net", F.col("lm_positive") - F.col("lm_negative"))
    return shares.join(of_title, key).join(of_body, key)


def daily_features(scores: DataFrame, days: DataFrame, day: str, next_window: bool = True) -> DataFrame:
    """One row per day of ``days (date, split, ..)`` with the aggregates of its articles and ``no_news``.

    With ``next_window`` a day is given the news of the next one, and the last
    day of each split goes.
    """
    names = [c for c in scores.columns if c.startswith(("valence_", "lm_"))]
    aggregates = [F.count(F.lit(1)).alias("n_articles"), *[F.avg(c).alias(f"{c}_mean") for c in names if c != "valence_neg_share"], F.min("valence_body").alias("valence_body_min"), F.avg("valence_neg_share").alias("valence_neg_share")]
    per_day = scores.groupBy(F.col(day).alias("news_date")).agg(*aggregates).filter("news_date is not null")
    spine = series.next_row_within_split(days) if next_window else days.withColumn("news_date", F.col("date"))
    joined = spine.join(per_day, "news_date", "left").withColumn("no_news", F.col("n_articles").isNull().cast("int"))
    return joined.fillna(0, [c for c in per_day.columns if c != "news_date"])
