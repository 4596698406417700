"""Queries of text cleaning, filters and duplicate removal, each with its SQL.

All queries read the stored text. The SQL engine knows no look-around and
counts ASCII word borders only, so its side writes borders and blanks as
classes of Unicode characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.operators import features, joins, metrics
from tidewire.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Word characters and blanks as Unicode has them.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_S = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{_S}]+'), lambda w: w <> '')"


def _squeezed_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{_S}]+', ' ', 'g'))"


def _quotes_sql(text: str) -> str:
    for sign, plain in (("’", "''"), ("‘", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - ")):
        text = f"replace({text}, '{sign}', '{plain}')"
    return text


def _plain_sql(text: str) -> str:
    """Plain quotes, nothing invisible, acronyms without their dots; a longer acronym goes before one it begins with."""
    text = f"regexp_replace({_quotes_sql(text)}, '{t.INVISIBLE}', '', 'g')"
    found = f"list_reverse_sort(list_distinct(regexp_extract_all({text}, '(?:^|[^{_W}])((?:[A-Z]\\.){{2,}})', 1)))"
    return f"list_reduce(list_prepend({text}, {found}), lambda a, m: replace(a, m, replace(m, '.', '')))"


def _doubled_sql(text: str) -> str:
    """Every sign that is no word character twice, so that matches between borders share none."""
    return f"(' ' || regexp_replace({text}, '([^{_W}])', '\\1\\1', 'g') || ' ')"


_HOST = "nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^(www|m|amp)\\.', ''), '')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"SELECT {_HOST} AS site, count(*) AS n FROM scrape_article WHERE status = 'success' AND trim(coalesce(body, '')) <> '' GROUP BY 1")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful pages with a body, per site."""
    df = table(spark, sf_dir, "scrape_article").filter((F.col("status") == "success") & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    return df.groupBy(t.site_of(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


_REQUIRED = ("author", "title", "date_published", "body", "discovery_title", "url")


@query("SELECT article_id FROM scrape_article WHERE " + " AND ".join(f"length(trim(coalesce({c}, ''))) > 0" for c in _REQUIRED))
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all six fields."""
    keep = F.lit(True)
    for c in _REQUIRED:
        keep = keep & (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return table(spark, sf_dir, "scrape_article").filter(keep).select("article_id")


@query("SELECT article_id, coalesce(try_strptime(date_published, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(substr(discovery_published, 6, 20), '%d %b %Y %H:%M:%S')) AS published FROM scrape_article")
def coalesce_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own time, else the feed's."""
    own = F.to_timestamp_ntz(F.when(F.col("date_published").rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$"), F.col("date_published")), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    feed = F.substring("discovery_published", 6, 20)
    feed = F.to_timestamp_ntz(F.when(feed.rlike(r"^\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}$"), feed), F.lit("dd MMM yyyy HH:mm:ss"))
    # A day that the month doesn't have counts as not written.
    valid = F.try_to_timestamp("date_published", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    return table(spark, sf_dir, "scrape_article").select("article_id", F.coalesce(F.when(valid, own), feed).alias("published"))


@query("SELECT aligned_id, CAST(CAST(published_at AT TIME ZONE 'UTC' + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS news_date FROM articles_aligned WHERE published_at AT TIME ZONE 'UTC' + INTERVAL 7 HOUR >= TIMESTAMP '2023-01-01' AND published_at AT TIME ZONE 'UTC' + INTERVAL 7 HOUR < TIMESTAMP '2024-01-01'")
def period_filter_wib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of 2023 in Jakarta time."""
    df = table(spark, sf_dir, "articles_aligned").withColumn("wib", F.to_utc_timestamp(F.from_utc_timestamp("published_at", "Asia/Jakarta"), "UTC"))
    day = F.date_format("wib", "yyyy-MM-dd")
    return df.filter((day >= "2023-01-01") & (day < "2024-01-01")).select("aligned_id", day.alias("news_date"))


@query("SELECT article_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '//www\\.', '//'), '/+$', '') AS link FROM scrape_article WHERE url IS NOT NULL")
def url_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls in normal form."""
    return table(spark, sf_dir, "scrape_article").filter("url is not null").select("article_id", t.normal_url(F.col("url")).alias("link"))


@query("SELECT is_cnbc, count(*) AS n, count(*) FILTER (regexp_matches(lower(source_url), '^https?://([a-z0-9-]+\\.)*nothiarkbrief\\.example')) AS brief FROM cnbc_discovered GROUP BY 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed hits by outlet, with a predicate on the host and its subdomains."""
    host = F.regexp_extract(F.lower("source_url"), "^https?://([^/]+)", 1)
    mine = (host == "nothiarkbrief.example") | host.endswith(".nothiarkbrief.example")
    return table(spark, sf_dir, "cnbc_discovered").groupBy("is_cnbc").agg(F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("brief"))


@query("SELECT trim(regexp_replace(lower(title_clean), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n FROM articles_aligned GROUP BY 1")
def text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that agree in letters and digits."""
    return table(spark, sf_dir, "articles_aligned").groupBy(t.text_key(F.col("title_clean")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT aligned_id, len({_words_sql('body_clean')}) AS n FROM articles_aligned")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between blanks."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", t.word_count(F.col("body_clean")).cast("bigint").alias("n"))


@query("SELECT aligned_id, replace(replace(replace(replace(replace(replace(body_clean, '’', ''''), '‘', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', ' - ') AS body FROM articles_aligned")
def plain_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typographic quotes and dashes as ASCII."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", t.plain_quotes(F.col("body_clean")).alias("body"))


@query(f"SELECT disc_id, trim(regexp_replace(regexp_replace({_plain_sql('title_rss')}, '(?i)[{_S}]+[-|][{_S}]+[A-Za-z]+[{_S}]*$', ''), '[ \\t\\r\\f\\x0b]+', ' ', 'g')) AS title FROM cnbc_discovered")
def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every headline in plain signs without the outlet at its end."""
    return table(spark, sf_dir, "cnbc_discovered").select("disc_id", t.clean_title(F.col("title_rss"), "[A-Za-z]+").alias("title"))


_NOTICE = "(?i)" + "|".join(t.NOTICE_PARAGRAPHS)
_PARAGRAPHS = f"""
p AS (SELECT aligned_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace({_plain_sql('body_clean')}, '(?i)https?://[^{_S}]+|www\\.[^{_S}]+|pic\\.twitter\\.com/[^{_S}]+', ' ', 'g'), '(^|[^{_W}.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '\\1 ', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0b]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM articles_aligned),
w AS (SELECT aligned_id, unnest(ps) AS q, unnest(range(len(ps))) AS i FROM p),
d AS (SELECT aligned_id, i, q, regexp_replace(q, '^[A-Z][A-Za-z.,'' ]{{2,40}}[{_S}]+\\((?:Reuters|AP)\\)[{_S}]*-[{_S}]*', '') AS q0 FROM w),
o AS (SELECT *, len({_words_sql('q')}) AS n, len({_words_sql('q0')}) AS n0 FROM d),
k AS (SELECT *, NOT (n < 4 OR n < 40 AND regexp_matches(q, '{_NOTICE}')) AS good, NOT (n0 < 4 OR n0 < 40 AND regexp_matches(q0, '{_NOTICE}')) AS good0 FROM o),
b AS (SELECT aligned_id, coalesce(min(i) FILTER (good0), 1000000000) AS first FROM k GROUP BY 1),
g AS (SELECT aligned_id, i, CASE WHEN i <= first THEN q0 ELSE q END AS q FROM k JOIN b USING (aligned_id) WHERE i = first OR i > first AND good),
f AS (SELECT aligned_id, q, min(i) AS i FROM g GROUP BY 1, 2)
"""


@query(f"WITH {_PARAGRAPHS} SELECT aligned_id, coalesce(string_agg(q, chr(10) ORDER BY i), '') AS body FROM p LEFT JOIN f USING (aligned_id) GROUP BY 1")
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs without short ones, notices, repeats and a dateline."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", t.clean_paragraphs(F.col("body_clean")).alias("body"))


def _bow_sql(text: str) -> str:
    plain = f"regexp_replace(replace(replace(lower({text}), 'can''t', 'cannot'), 'won''t', 'will not'), 'n''t([^{_W}]|$)', ' not\\1', 'g')"
    return f"replace(regexp_replace({plain}, '''s([^{_W}]|$)', '\\1', 'g'), '''', '')"


_KEEP = {"no", "not", "nor", "never", "none", "cannot", "without", "us"}
_BOW = f"list_filter(regexp_extract_all({_bow_sql('body_clean')}, '[a-z]{{2,}}', 0), lambda w: NOT list_contains({_list([w for w in t.STOPWORDS if w not in _KEEP])}, w))"


@query(f"SELECT aligned_id, array_to_string({_BOW}, ' ') AS bow FROM articles_aligned")
def bow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as bags of words."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", t.bag_of_words(F.col("body_clean")).alias("bow"))


_LEMMA = """list_transform({}, lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
WHEN w LIKE '%es' AND length(w) > 3 AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 2)
WHEN w LIKE '%s' AND length(w) > 2 AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END)"""


def _tokens_sql(text: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+''[a-z]+|[{_W}]+', 0), lambda w: regexp_full_match(w, '[a-z0-9]+(?:''[a-z]+)?'))"
    return f"list_transform({found}, lambda w: regexp_replace(w, '''s$', ''))"





def _classical_sql(text: str) -> str:
    return f"list_filter({_LEMMA.format(_tokens_sql(text))}, lambda w: NOT list_contains({_list([w for w in t.STOPWORDS if w not in t.NEGATIONS])}, w) AND (length(w) >= 3 OR list_contains({_list(t.NEGATIONS)}, w)))"


_CLASSICAL = _classical_sql("title_clean")


@query(f"SELECT aligned_id, array_to_string({_LEMMA.format(_tokens_sql('title_clean'))}, ' ') AS lemmas FROM articles_aligned")
def lemma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with plural endings removed by rule."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", F.array_join(F.transform(t.word_tokens(F.col("title_clean")), t.lemma), " ").alias("lemmas"))


@query(f"WITH c AS (SELECT aligned_id, {_CLASSICAL} AS ws FROM articles_aligned) SELECT aligned_id, array_to_string(ws, ' ') AS unigrams, array_to_string(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]), ' ') AS bigrams FROM c")
def classical_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as lemmas without stop words but with negations, and their bigrams."""
    df = table(spark, sf_dir, "articles_aligned").select("aligned_id", t.classical_tokens(F.col("title_clean")).alias("ws"))
    return df.select("aligned_id", F.array_join("ws", " ").alias("unigrams"), F.array_join(t.bigrams(F.col("ws")), " ").alias("bigrams"))


_ENTITIES = f"list_transform(regexp_extract_all({_doubled_sql('title_clean')}, '[^{_W}]([A-Z][a-z]+(?:[{_S}]+[A-Z][a-z]+)*)[^{_W}]', 1), lambda e: regexp_replace(e, '([{_S}])[{_S}]', '\\1', 'g'))"
_FIGURES = f"list_transform(regexp_extract_all({_doubled_sql('body_clean')}, '[^{_W}](\\p{{Nd}}+(?:(?:,,|\\.\\.)\\p{{Nd}}+)*)[^{_W}]', 1), lambda e: replace(replace(e, ',,', ','), '..', '.'))"


@query(f"SELECT aligned_id, array_to_string(list_sort(list_distinct({_ENTITIES})), '|') AS entities, array_to_string(list_sort(list_distinct({_FIGURES})), '|') AS numbers FROM articles_aligned")
def preserved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised runs and numbers, distinct and sorted."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", F.array_join(t.entities(F.col("title_clean")), "|").alias("entities"), F.array_join(t.numbers(F.col("body_clean")), "|").alias("numbers"))


def _hits_sql(terms, column: str) -> str:
    """Distinct terms in first-seen order. Gaps and hyphens are doubled like the text's."""
    ordered = sorted(set(terms), key=lambda x: (-len(x), x))
    pattern = "|".join(x.replace("-", "--").replace(" ", "  ") for x in ordered)
    found = f"regexp_extract_all({_doubled_sql(f'lower({column})')}, '[^{_W}]({pattern})[^{_W}]', 1)"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


@query(f"SELECT aligned_id, replace(array_to_string({_hits_sql(t.keyword_terms(), 'body_clean')}, '|'), '  ', ' ') AS hits FROM articles_aligned")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keywords of each body in first-seen order."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", F.array_join(t.term_hits(F.col("body_clean"), t.keyword_terms()), "|").alias("hits"))


@query(f"""WITH h AS (SELECT aligned_id, len({_hits_sql(t.GEO_TERMS, 'title_clean')}) AS th, len({_hits_sql(t.GEO_TERMS, "(title_clean || ' ' || body_clean)")}) AS n FROM articles_aligned)
SELECT aligned_id, n AS geo_hits FROM h WHERE th >= 1 OR n >= 2""")
def geo_hits_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a geopolitical term in the title or two different ones at all."""
    df = table(spark, sf_dir, "articles_aligned").withColumn("both", F.concat_ws(" ", "title_clean", "body_clean"))
    df = df.select("aligned_id", F.size(t.term_hits(F.col("title_clean"), t.GEO_TERMS)).alias("th"), F.size(t.term_hits(F.col("both"), t.GEO_TERMS)).cast("bigint").alias("geo_hits"))
    return df.filter("th >= 1 or geo_hits >= 2").select("aligned_id", "geo_hits")


_NOISE = (r"talks: why", r"^exclusive", r"\brisk grows\b")


@query(f"SELECT article_id FROM scrape_article WHERE NOT regexp_matches(title, '(?i){'|'.join((*t.NOISE_TITLES, *_NOISE))}')")
def noise_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title fits none of the patterns."""
    return table(spark, sf_dir, "scrape_article").filter(~F.col("title").rlike("(?i)" + "|".join((*t.NOISE_TITLES, *_NOISE)))).select("article_id")


@query("""WITH q AS (SELECT quantile_cont(n_words, 0.25) AS a, quantile_cont(n_words, 0.75) AS b FROM articles_aligned) SELECT aligned_id, n_words FROM articles_aligned, q WHERE n_words >= 100 AND n_words <= b + 3 * (b - a)""")
def iqr_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of at least 100 words and no outliers by the interquartile range."""
    df = table(spark, sf_dir, "articles_aligned")
    q = df.agg(F.percentile("n_words", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return df.crossJoin(F.broadcast(q)).filter((F.col("n_words") >= 100) & (F.col("n_words") <= F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0]))).select("aligned_id", "n_words")


_LINK = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '//www\\.', '//'), '/+$', '')"
_TURNS = f"""
a AS (SELECT aligned_id, published_at, news_date_wib AS d, {_LINK} AS link, trim(regexp_replace(lower(title_clean), '[^a-z0-9]+', ' ', 'g')) AS tk, trim(regexp_replace(lower(body_clean), '[^a-z0-9]+', ' ', 'g')) AS bk FROM articles_aligned),
d1 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY published_at NULLS FIRST, aligned_id) AS k FROM a) WHERE k = 1 OR link IS NULL),
d2 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY tk, d ORDER BY published_at NULLS FIRST, aligned_id) AS k FROM d1) WHERE k = 1 OR tk IS NULL OR d IS NULL),
d3 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY bk ORDER BY published_at NULLS FIRST, aligned_id) AS k FROM d2) WHERE k = 1 OR bk IS NULL)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", "published_at", F.col("news_date_wib").alias("d"), t.normal_url(F.col("url")).alias("link"), t.text_key(F.col("title_clean")).alias("tk"), F.md5(t.text_key(F.col("body_clean"))).alias("bk"))


_ORDER = ["published_at", "aligned_id"]


@query(f"WITH {_TURNS} SELECT aligned_id FROM d1")
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest article of each link."""
    return joins.keep_first(_keyed(spark, sf_dir), ["link"], _ORDER).select("aligned_id")


@query(f"WITH {_TURNS} SELECT aligned_id FROM d3")
def dedup_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest article by link, then by title and day, then by body."""
    return joins.keep_first_in_turn(_keyed(spark, sf_dir), [["link"], ["tk", "d"], ["bk"]], _ORDER).select("aligned_id")


@query(f"""WITH {_TURNS}, c AS (SELECT 0 AS step, 'all' AS stage, count(*) AS rows FROM a UNION ALL SELECT 1, 'link', count(*) FROM d1 UNION ALL SELECT 2, 'title and day', count(*) FROM d2 UNION ALL SELECT 3, 'body', count(*) FROM d3)
SELECT CAST(step AS INT) AS step, stage, rows, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0) AS dropped FROM c""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage leaves and drops."""
    a = _keyed(spark, sf_dir)
    first = joins.keep_first(a, ["link"], _ORDER)
    second = joins.keep_first(first, ["tk", "d"], _ORDER)
    return metrics.funnel([("all", a), ("link", first), ("title and day", second), ("body", joins.keep_first(second, ["bk"], _ORDER))])


@query("SELECT disc_id FROM (SELECT disc_id, row_number() OVER (PARTITION BY k ORDER BY disc_id) AS n2, k FROM (SELECT disc_id, trim(regexp_replace(lower(title_rss), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS k FROM (SELECT *, row_number() OVER (PARTITION BY rss_link ORDER BY disc_id) AS n1 FROM cnbc_discovered) WHERE n1 = 1 OR rss_link IS NULL)) WHERE n2 = 1 OR k IS NULL")
def dedup_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed hits by link, then by title, the first found first."""
    df = table(spark, sf_dir, "cnbc_discovered").withColumn("k", F.trim(F.regexp_replace(F.lower("title_rss"), r"[ \t\r\n\f]+", " ")))
    return joins.keep_first_in_turn(df, [["rss_link"], ["k"]], ["disc_id"]).select("disc_id")


@query("SELECT rss_link, count(*) AS hits FROM cnbc_discovered WHERE rss_link NOT IN (SELECT rss_link FROM scrape_article WHERE rss_link IS NOT NULL) GROUP BY 1")
def resume_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that no page was fetched for."""
    todo = joins.not_yet_done(table(spark, sf_dir, "cnbc_discovered").filter("rss_link is not null"), table(spark, sf_dir, "scrape_article"), "rss_link")
    return todo.groupBy("rss_link").agg(F.count(F.lit(1)).alias("hits"))


_FEED = "SELECT rss_link, min(title_rss) AS title, min(published_rss) AS date_published, min(source) AS author, min(source_url) AS url FROM cnbc_discovered GROUP BY 1"


@query("SELECT article_id, " + ", ".join(f"coalesce(d.{c}, a.{c}) AS {c}" for c in ("title", "date_published", "author", "url")) + f" FROM scrape_article a LEFT JOIN ({_FEED}) d USING (rss_link)")
def combine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fields of the feed where there are any, else the page's."""
    names = {"title": "title_rss", "date_published": "published_rss", "author": "source", "url": "source_url"}
    feed = table(spark, sf_dir, "cnbc_discovered").groupBy("rss_link").agg(*[F.min(c).alias(n) for n, c in names.items()])
    return joins.fill_from(table(spark, sf_dir, "scrape_article").select("article_id", "rss_link", *names), feed, "rss_link", list(names)).select("article_id", *names)


_SHINGLES = """list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)"""


@query(f"""WITH w AS (SELECT a.article_id, regexp_extract_all(lower(a.title), '[a-z0-9]+', 0) AS ws, regexp_extract_all(lower(a.discovery_title), '[a-z0-9]+', 0) AS ws2 FROM scrape_article a WHERE title IS NOT NULL AND discovery_title IS NOT NULL),
s AS (SELECT article_id, {_SHINGLES} AS x, {_SHINGLES.replace('ws', 'ws2')} AS y FROM w)
SELECT article_id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS jaccard FROM s""")
def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the page's title and the feed's are."""
    df = table(spark, sf_dir, "scrape_article").filter("title is not null and discovery_title is not null")
    return df.select("article_id", F.round(t.jaccard(t.shingles(F.col("title")), t.shingles(F.col("discovery_title"))), 6).alias("jaccard"))


def _kept_sql(source: str) -> str:
    """Greedy choice of paragraphs, one a step, from ``source (id, text)``."""
    one = "list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)"
    trimmed = f"regexp_replace(regexp_replace(x, '^[{_S}]+', ''), '[{_S}]+$', '')"
    return f"""src AS ({source}),
par AS (SELECT id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: {trimmed}), lambda x: x <> '') AS ps FROM src),
ws AS (SELECT id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM par),
tok AS (SELECT id, i, p, lower({_squeezed_sql('p')}) AS k, regexp_extract_all(lower(p), '[a-z0-9]+', 0) AS ws FROM ws),
shi AS (SELECT id, i, p, k, {one} AS s FROM tok),
rec AS (SELECT id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(p VARCHAR, k VARCHAR, s VARCHAR[])[]) AS kept, 0 AS n_exact, 0 AS n_near FROM src WHERE text IS NOT NULL
 UNION ALL
 SELECT id, i, CASE WHEN same OR near THEN kept ELSE list_append(kept, {{'p': p, 'k': k, 's': s}}) END, n_exact + CAST(same AS INT), n_near + CAST(NOT same AND near AS INT)
 FROM (SELECT r.id, h.i, r.kept, r.n_exact, r.n_near, h.p, h.k, h.s, len(list_filter(r.kept, lambda q: q.k = h.k)) > 0 AS same,
   len(list_filter(r.kept, lambda q: CASE WHEN len(q.s) > 0 AND len(h.s) > 0 THEN len(list_intersect(q.s, h.s)) / (len(q.s) + len(h.s) - len(list_intersect(q.s, h.s)))::DOUBLE >= 0.8 ELSE q.p = h.p END)) > 0 AS near
  FROM rec r JOIN shi h ON h.id = r.id AND h.i = r.i + 1)),
fin AS (SELECT id, arg_max(list_transform(kept, lambda q: q.p), i) AS kept, max(n_exact) AS n_exact, max(n_near) AS n_near, max(i) AS n FROM rec GROUP BY id)"""


@query(f"WITH RECURSIVE {_kept_sql('SELECT aligned_id AS id, body_clean AS text FROM articles_aligned')} SELECT id AS aligned_id, array_to_string(kept, chr(10)) AS body, CAST(n_exact AS INT) AS n_exact, CAST(n_near AS INT) AS n_near FROM fin")
def unique_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without paragraphs that repeat an earlier one almost, with how many went."""
    df = table(spark, sf_dir, "articles_aligned").filter("body_clean is not null").select("aligned_id", t.deduplicated(F.col("body_clean")).alias("d"))
    return df.select("aligned_id", F.array_join("d.kept", "\n").alias("body"), "d.n_exact", "d.n_near")


def _masked_sql(text: str) -> str:
    plain = f"nfc_normalize(coalesce({text}, ''))"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', '{sign}')"
    plain = f"regexp_replace(regexp_replace({plain}, '<[^>]+>', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', ' ', 'g')"
    plain = f"regexp_replace({plain}, '(^|[^{_W}.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '\\1EMAIL', 'g')"
    return f"regexp_replace({plain}, '(?i)https?://[^{_S}]+|www\\.[^{_S}]+|(?:[a-zA-Z0-9-]+\\.)+(?:com|org|net|gov|edu|io|id|co)\\b[^{_S}]*', 'URL', 'g')"


def _visible_sql(text: str) -> str:
    return _squeezed_sql(f"replace({text}, chr(8203), '')")


@query(f"SELECT doc_id, {_visible_sql(_masked_sql('text'))} AS masked FROM documents")
def mask_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without tags and control characters, addresses masked."""
    return table(spark, sf_dir, "documents").select("doc_id", t.light_clean(F.col("text"), deduplicate=False).alias("masked"))


def light_sql(source: str) -> str:
    """``light (id, light)`` of ``source (id, body)``."""
    return f"""src0 AS ({source}), {_kept_sql(f"SELECT id, {_masked_sql('body')} AS text FROM src0")},
light AS (SELECT id, {_visible_sql("CASE WHEN n > 1 THEN array_to_string(kept, ' ') ELSE text END")} AS light FROM fin JOIN src USING (id))"""


@query(f"WITH RECURSIVE {light_sql('SELECT aligned_id AS id, body_clean AS body FROM articles_aligned')} SELECT id AS aligned_id, light FROM light")
def light_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies composed, unescaped, without tags, masked, without repeated paragraphs, squeezed."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", t.light_clean(F.col("body_clean")).alias("light"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of semi-structured properties."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "value")


@query("SELECT article_id, left(coalesce(body, ''), 500) AS preview, left(coalesce(title, ''), 40) AS label FROM scrape_article")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened fields for a look."""
    return table(spark, sf_dir, "scrape_article").select("article_id", F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("preview"), F.substring(F.coalesce("title", F.lit("")), 1, 40).alias("label"))


@query(f"SELECT aligned_id, len(list_filter(string_split_regex(regexp_replace(body_clean, '([.!?])[{_S}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: len({_words_sql('s')}) >= 3)) AS sentences FROM articles_aligned")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at least three words."""
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", F.size(t.sentences(F.col("body_clean"))).cast("bigint").alias("sentences"))


_TERMS = f"tok AS (SELECT aligned_id, split, news_date_wib AS day, unnest({_BOW}) AS term FROM articles_aligned), cnt AS (SELECT aligned_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles_aligned").select("aligned_id", "split", F.col("news_date_wib").alias("day"), F.col("n_words").cast("bigint").alias("n_words"), F.filter(F.split(t.bag_of_words(F.col("body_clean")), " "), lambda w: w != "").alias("tokens"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY 1")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequencies."""
    return features.document_frequency(features.term_counts(_bags(spark, sf_dir), "aligned_id", "tokens"))


@query(f"WITH {_TERMS}, n AS (SELECT count(*) AS n FROM articles_aligned), v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY 1) SELECT term, df, total FROM v, n WHERE df >= 5 AND df <= 0.8::DOUBLE * n ORDER BY total DESC, term LIMIT 200")
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent terms within bounds of document frequency."""
    bags = _bags(spark, sf_dir)
    return features.vocabulary(features.term_counts(bags, "aligned_id", "tokens"), bags.agg(F.count(F.lit(1)).alias("n")), 5, 0.8, 200)


_TFIDF = f"""{_TERMS.replace('cnt AS', 'cnta AS')}, cnt AS (SELECT day, split, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
n AS (SELECT count(DISTINCT day) AS n FROM tok WHERE split = 'train'), v0 AS (SELECT term, count(*) AS df, sum(tf) AS total FROM cnt WHERE split = 'train' GROUP BY 1),
v AS (SELECT term, df FROM v0, n WHERE df >= 5 AND df <= 0.8::DOUBLE * n ORDER BY total DESC, term LIMIT 300),
raw AS (SELECT day, split, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM cnt JOIN v USING (term), n),
unit AS (SELECT day, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY day, split)) AS w FROM raw)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = _bags(spark, sf_dir).withColumn("key", F.struct("day", "split"))
    counts = cut(features.term_counts(bags, "key", "tokens"), "counts")
    train = counts.filter("key.split = 'train'")
    n = bags.filter("split = 'train' and size(tokens) > 0").agg(F.count_distinct("day").alias("n"))
    return features.tfidf(counts, features.vocabulary(train, n, 5, 0.8, 300), n, "key").select("key.day", "key.split", "term", "w")


@query(f"WITH {_TFIDF} SELECT day, split, term, round(w, 6) AS w FROM unit")
def tfidf_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit weights of the terms of each day; vocabulary and frequencies from train alone."""
    return _weights(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(f"WITH {_TFIDF}, d AS (SELECT count(DISTINCT day) AS d FROM unit WHERE split = 'train') SELECT term, round(sum(w) / d, 6) AS mean_weight FROM unit, d WHERE split = 'train' GROUP BY term, d ORDER BY mean_weight DESC, term LIMIT 20")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 terms of the largest mean weight on train."""
    w = _weights(spark, sf_dir).filter("split = 'train'")
    n = w.agg(F.count_distinct("day").alias("n"))
    return w.groupBy("term").agg(F.sum("w").alias("s")).crossJoin(F.broadcast(n)).select("term", F.round(F.col("s") / F.col("n"), 6).alias("mean_weight")).orderBy(F.desc("mean_weight"), "term").limit(20)


#: A small lexicon of the queries; a real one is an input table.
LEXICON = {"negative": ("slipped", "lost", "conflict", "war", "dispute", "blockade", "embargo", "sanctions", "protest"), "positive": ("gained", "rose", "surplus", "recovered", "firmed"), "uncertainty": ("risk", "cautious", "tense", "intervention", "may")}
_LEX = "lex(word, category) AS (VALUES " + ", ".join(f"('{w}', '{c}')" for c, ws in LEXICON.items() for w in ws) + ")"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, c) for c, ws in LEXICON.items() for w in ws], "word string, category string")


@query(f"""WITH {_LEX}, {_TERMS}, h AS (SELECT aligned_id, category, count(*) AS n FROM tok JOIN lex ON term = word GROUP BY 1, 2)
SELECT a.aligned_id, {", ".join(f"round(coalesce(sum(n) FILTER (category = '{c}'), 0) / greatest(n_words, 1)::DOUBLE, 8) AS {c}" for c in LEXICON)}, round((coalesce(sum(n) FILTER (category = 'positive'), 0) - coalesce(sum(n) FILTER (category = 'negative'), 0)) / greatest(n_words, 1)::DOUBLE, 8) AS net FROM articles_aligned a LEFT JOIN h USING (aligned_id) GROUP BY a.aligned_id, n_words""")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of words in each category of a lexicon, and positive less negative."""
    out = features.lexicon_scores(_bags(spark, sf_dir), F.broadcast(_lexicon(spark)), "aligned_id", "tokens", "n_words", tuple(LEXICON))
    return out.select("aligned_id", *[F.round(c, 8).alias(c) for c in LEXICON], F.round(F.col("positive") - F.col("negative"), 8).alias("net"))


@query(f"""WITH {_LEX}, v AS (SELECT word, CASE category WHEN 'negative' THEN -2.0 WHEN 'positive' THEN 2.0 ELSE -0.5 END AS x FROM lex), {_TERMS}, s AS (SELECT aligned_id, CAST(sum(x) AS DOUBLE) AS s FROM tok JOIN v ON term = word GROUP BY 1)
SELECT a.aligned_id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound FROM articles_aligned a LEFT JOIN s USING (aligned_id)""")
def valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squashed sums of word valences."""
    lexicon = _lexicon(spark).select("word", F.when(F.col("category") == "negative", -2.0).when(F.col("category") == "positive", 2.0).otherwise(-0.5).alias("valence"))
    return features.valence(_bags(spark, sf_dir), F.broadcast(lexicon), "aligned_id", "tokens").withColumn("compound", F.round("compound", 6))


@query(f"WITH {_TERMS}, v AS (SELECT DISTINCT term FROM tok WHERE split = 'train') SELECT split, count(*) AS tokens, count(v.term) AS known, round(count(v.term) / count(*)::DOUBLE, 6) AS coverage FROM tok LEFT JOIN v USING (term) GROUP BY 1")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tokens that occur in train."""
    bags = _bags(spark, sf_dir)
    known = bags.filter("split = 'train'").select(F.explode("tokens").alias("term")).distinct()
    return features.token_coverage(bags, known, "split", "tokens").withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_TERMS}, a AS (SELECT DISTINCT term FROM tok WHERE split = 'train'), b AS (SELECT DISTINCT term FROM tok WHERE split = 'val'), c AS (SELECT DISTINCT term FROM tok WHERE split = 'test') SELECT (SELECT count(*) FROM (SELECT term FROM a INTERSECT SELECT term FROM b INTERSECT SELECT term FROM c)) AS in_all, (SELECT count(*) FROM (SELECT term FROM c EXCEPT SELECT term FROM a)) AS only_test, (SELECT count(*) FROM (SELECT term FROM a UNION SELECT term FROM b UNION SELECT term FROM c)) AS in_any")
def vocabulary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of the splits' vocabularies."""
    terms = _bags(spark, sf_dir).select("split", F.explode("tokens").alias("term")).distinct()
    a, b, c = (terms.filter(F.col("split") == s).select("term") for s in ("train", "val", "test"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a.intersect(b).intersect(c), "in_all").crossJoin(n(c.subtract(a), "only_test")).crossJoin(n(a.union(b).union(c).distinct(), "in_any"))


@query("WITH d AS (SELECT news_date_wib AS day, string_agg(title_clean, ' ' ORDER BY aligned_id) AS document FROM articles_aligned WHERE title_clean IS NOT NULL GROUP BY 1) SELECT day, document FROM d")
def day_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles of a day, in order."""
    return features.day_documents(table(spark, sf_dir, "articles_aligned").withColumnRenamed("news_date_wib", "day"), "day", "aligned_id", "title_clean")


@query("WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(CAST(x AS DOUBLE)), 6) + 0.0::DOUBLE AS x FROM e GROUP BY 1, 2")
def vector_pool_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each group."""
    return features.pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("x", F.round("x", 6))


_NUMBER = "1 + (length(term) * 131 + ascii(term)) % 400"


@query(f"""WITH {_TERMS}, known AS (SELECT day, {_NUMBER} AS vec_id, count(*) AS n FROM tok WHERE length(term) >= 6 GROUP BY 1, 2), days AS (SELECT DISTINCT news_date_wib AS day FROM articles_aligned), places AS (SELECT day, CAST(i AS INT) AS i FROM days, range(64) t(i)),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), p AS (SELECT day, CAST(i AS INT) AS i, sum(n * CAST(x AS DOUBLE)) / sum(n) AS x FROM known JOIN e USING (vec_id) GROUP BY 1, 2)
SELECT day, i, round(coalesce(x, 0), 6) + 0.0::DOUBLE AS x FROM places LEFT JOIN p USING (day, i)""")
def vector_pool_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per day over all known tokens; words of six letters are known, a day without any has zeros."""
    bags = _bags(spark, sf_dir)
    terms = bags.select(F.explode("tokens").alias("term")).filter("length(term) >= 6").distinct().withColumn("vec_id", F.expr(_NUMBER).cast("bigint"))
    vectors = table(spark, sf_dir, "embeddings").join(terms, "vec_id").select("term", F.posexplode("embedding").alias("i", "x"))
    long = features.pooled_by_token(bags, vectors.withColumn("x", F.col("x").cast("double")), "day", "tokens")
    return features.zero_filled(long, bags, "day", 64).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(f"""WITH {_TERMS}, tp(topic, rank, term) AS (VALUES (1, 1, 'rupiah'), (1, 2, 'trillion'), (1, 3, 'bonds'), (2, 1, 'percent'), (2, 2, 'trade'), (2, 3, 'early')),
p AS (SELECT a.topic, a.term AS l, b.term AS e FROM tp a JOIN tp b ON a.topic = b.topic AND a.rank > b.rank),
s AS (SELECT topic, ln(((SELECT count(*) FROM cnt x JOIN cnt y USING (aligned_id) WHERE x.term = l AND y.term = e) + 1) / greatest((SELECT count(*) FROM cnt x WHERE x.term = l), 1)::DOUBLE) AS v FROM p)
SELECT round(avg(m), 6) AS coherence FROM (SELECT avg(v) AS m FROM s GROUP BY topic)""")
def umass_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of two given topics."""
    topics = spark.createDataFrame([(1, 1, "rupiah"), (1, 2, "trillion"), (1, 3, "bonds"), (2, 1, "percent"), (2, 2, "trade"), (2, 3, "early")], "topic int, rank int, term string")
    doc_terms = _bags(spark, sf_dir).select(F.col("aligned_id").alias("id"), F.explode("tokens").alias("term")).distinct()
    return features.coherence(doc_terms, topics).withColumn("coherence", F.round("coherence", 6))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INT), 1)) AS HUGEINT))), lambda h, b: (xor(CAST(h AS HUGEINT), b) * 16777619) % 4294967296)"


@query(f"SELECT DISTINCT source, CAST({_FNV.format('source')} % 50000 AS BIGINT) AS bucket FROM documents")
def fnv_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable hash buckets of names."""
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", t.fnv1a(F.col("source"), 50000).alias("bucket"))


@query("WITH s AS (SELECT DISTINCT source, '<' || source || '>' AS m FROM documents), g AS (SELECT source, substr(m, CAST(i AS INT), CAST(n AS INT)) AS g FROM s, range(3, 7) a(n), range(1, 60) b(i) WHERE i <= length(m) - n + 1) SELECT source, count(DISTINCT g) AS grams FROM g GROUP BY 1")
def character_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct border-marked substrings of names."""
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", F.size(t.character_grams(F.col("source"))).cast("bigint").alias("grams"))


@query(f"SELECT source, array_to_string(list_sort(list_distinct(list_transform(g, lambda x: CAST({_FNV.format('x')} % 50000 AS BIGINT)))), ' ') AS buckets FROM (SELECT source, list(DISTINCT g) AS g FROM (SELECT source, substr(m, CAST(i AS INT), CAST(n AS INT)) AS g FROM (SELECT DISTINCT source, '<' || source || '>' AS m FROM documents), range(3, 7) a(n), range(1, 60) b(i) WHERE i <= length(m) - n + 1) GROUP BY 1)")
def gram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash buckets of the border-marked substrings of names."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", F.array_join(F.array_sort(F.array_distinct(F.transform(t.character_grams(F.col("source")), lambda g: t.fnv1a(g, 50000)))), " ").alias("buckets"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each language."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").filter("lang is not null").withColumn("k", k).filter("k <= 3").select("lang", "doc_id", "n_chars")


_COS = f"""{_TERMS.replace('tok AS (', 'tok0 AS (').replace('FROM tok ', 'FROM tok0 ')}, n AS (SELECT count(*) AS n FROM articles_aligned), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM cnt GROUP BY 1 ORDER BY total DESC, term LIMIT 50000),
w AS (SELECT aligned_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM cnt JOIN df USING (term), n), u AS (SELECT aligned_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY aligned_id)) AS w FROM w),
near AS (SELECT a.aligned_id AS a, b.aligned_id AS b FROM u a JOIN u b ON a.term = b.term AND a.aligned_id < b.aligned_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.9)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles_aligned")
    # Tokens are made once; frequencies and vectors are both taken from the bags, one for each key.
    bags = articles.select(F.col("aligned_id").alias("id"), t.bag_of_words(F.col("body_clean")).alias("bag")).groupBy("id")
    bags = cut(bags.agg(F.concat_ws(" ", F.collect_list("bag")).alias("bag")), "bags")
    terms = cut(features.bag_frequency(bags).orderBy(F.desc("total"), "term").limit(50_000), "terms")
    # At most 50,000 rows, the rarest first.
    listed = [(r["term"], r["df"]) for r in terms.orderBy("df", "term").collect()]
    vectors = features.bag_vectors(bags.filter("id is not null"), listed, articles.count())
    return joins.similar_vectors(cut(vectors, "vectors"))


@query(f"WITH {_COS} SELECT a, b FROM near")
def near_dup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles of a cosine of 0.9 or more over the 50,000 most frequent terms, exact by prefix filtering."""
    return _near(spark, sf_dir).select("a", "b")


@query(f"WITH {_COS} SELECT aligned_id FROM articles_aligned WHERE aligned_id NOT IN (SELECT b FROM near)")
def near_dup_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that resemble no earlier one."""
    return joins.without_similar(table(spark, sf_dir, "articles_aligned").select("aligned_id"), _near(spark, sf_dir), "aligned_id")


@query("SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY GROUPING SETS ((source, lang), (source), ()))")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and language with totals."""
    out = table(spark, sf_dir, "documents").filter("lang is not null").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n")
