"""Queries of the daily series, calendars, splits and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import calendar, joins, metrics, series
from tidewire.runtime import table

LABELS = series.LABELS
#: Closed days of the calendar queries.
HOLIDAYS = ("2024-01-01", "2024-01-15")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


_RATES = """
raw AS (SELECT trim(tanggal) AS t, try_cast(trim(kurs_jisdor) AS DOUBLE) AS r FROM jisdor_clean),
parsed AS (SELECT CASE WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_cast(try_strptime(t, '%m/%d/%Y') AS DATE)
                       WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE) END AS date, r FROM raw),
rates AS (SELECT date, CAST(round_even(avg(r), 0) AS BIGINT) AS rate FROM parsed WHERE date IS NOT NULL AND r > 0 GROUP BY date)
"""
_CHANGES = _RATES + """,
pct AS (SELECT *, (rate / lag(rate) OVER (ORDER BY date) - 1) * 100 AS pct_change FROM rates),
lab AS (SELECT *, CASE WHEN pct_change > 0.1 THEN 'NAIK' WHEN pct_change < -0.1 THEN 'TURUN' WHEN pct_change IS NOT NULL THEN 'STABIL' END AS lab FROM pct),
chg AS (SELECT date, rate, pct_change, lead(lab) OVER (ORDER BY date) AS target, lead(rate) OVER (ORDER BY date) AS rate_next, lead(rate) OVER (ORDER BY date) - rate AS delta_next FROM lab)
"""
_SPLIT = _CHANGES + """,
num AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM chg WHERE target IS NOT NULL AND pct_change IS NOT NULL),
spl AS (SELECT date, rate, pct_change, target, rate_next, delta_next, CASE WHEN i < floor(n * 0.8::DOUBLE) - 1 THEN 'train' WHEN i >= floor(n * 0.8::DOUBLE) AND i < floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) - 1 THEN 'val' WHEN i >= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'test' END AS split FROM num)
"""
_PERSIST = _SPLIT + """,
cnt AS (SELECT split, target, count(*) AS c FROM spl WHERE split IS NOT NULL GROUP BY 1, 2),
md AS (SELECT split, target AS m FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c DESC, target) AS k FROM cnt) WHERE k = 1),
prd AS (SELECT s.*, coalesce(lag(s.target) OVER (PARTITION BY s.split ORDER BY s.date), m) AS prediction FROM spl s JOIN md USING (split))
"""
_CELLS = """
lbl AS (SELECT unnest(['NAIK', 'STABIL', 'TURUN']) AS l),
cells AS (SELECT s.split, a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM prd p WHERE p.split = s.split AND p.target = a.l AND p.prediction = b.l) AS n FROM (SELECT DISTINCT split FROM prd) s, lbl a, lbl b)
"""
_CLASSES = _CELLS + """,
pc AS (SELECT split, l AS label, sum(CASE WHEN y_true = l THEN n ELSE 0 END) AS support, sum(CASE WHEN y_pred = l THEN n ELSE 0 END) AS predicted, sum(CASE WHEN y_true = l AND y_pred = l THEN n ELSE 0 END) AS hit FROM cells, lbl GROUP BY 1, 2),
sc AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, coalesce(2 * hit / nullif(support + predicted, 0), 0) AS f1 FROM pc)
"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clean_rates(table(spark, sf_dir, "jisdor_clean"), "tanggal", "kurs_jisdor")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.changes(_rates(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.chronological_split(_changes(spark, sf_dir).dropna(subset=["target", "pct_change"]))


def _persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.persistence(_split(spark, sf_dir))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "daily_kurs_split")


@query(f"WITH {_RATES} SELECT date, rate FROM rates")
def clean_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string rates, coerced, filtered, repeated days averaged."""
    return _rates(spark, sf_dir)


@query(f"WITH {_RATES} SELECT count(*) FILTER (date IS NULL) AS bad_date, count(*) FILTER (date IS NOT NULL AND r IS NULL) AS bad_rate, count(*) FILTER (date IS NOT NULL AND r <= 0) AS not_positive FROM parsed")
def rejected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each rule drops."""
    return series.rejected_rates(table(spark, sf_dir, "jisdor_clean"), "tanggal", "kurs_jisdor")


@query(f"WITH {_CHANGES} SELECT date, rate, round(pct_change, 6) AS pct_change, target, CAST(rate_next AS DOUBLE) AS rate_next, CAST(delta_next AS DOUBLE) AS delta_next FROM chg")
def daily_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in percent, tomorrow's label, rate and difference."""
    out = _changes(spark, sf_dir).withColumn("pct_change", F.round("pct_change", 6))
    return out.withColumn("rate_next", F.col("rate_next").cast("double")).withColumn("delta_next", F.col("delta_next").cast("double"))


@query(f"""WITH {_RATES}, l AS (SELECT date, rate, ln(rate / lag(rate) OVER (ORDER BY date)) AS g FROM rates)
SELECT date, round(g, 8) AS log_return, round(lag(g, 1) OVER w, 8) AS ret_lag1, round(lag(g, 2) OVER w, 8) AS ret_lag2, round(lag(g, 3) OVER w, 8) AS ret_lag3,
round(CASE WHEN count(g) OVER f = 5 THEN stddev_samp(g) OVER f END, 8) AS ret_std5 FROM l WINDOW w AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def lag_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns, their lags and a rolling deviation."""
    out = series.lagged_returns(_rates(spark, sf_dir))
    return out.select("date", *[_r(c, 8) for c in ("log_return", "ret_lag1", "ret_lag2", "ret_lag3", "ret_std5")])


@query(f"""WITH {_RATES}, l AS (SELECT date, rate, ln(rate / lag(rate) OVER (ORDER BY date)) AS g FROM rates), d AS (SELECT *, CASE WHEN g IS NOT NULL THEN CAST(g > 0 AS INT) END AS dir FROM l)
SELECT date, round(g, 8) AS log_ret, CAST(dir AS DOUBLE) AS direction, round(lead(g) OVER w, 8) AS ret_next, CAST(lead(dir) OVER w AS DOUBLE) AS direction_next, CAST(date - lag(date) OVER w AS DOUBLE) AS gap_days, CAST(isodow(date) - 1 AS INT) AS dayofweek FROM d WINDOW w AS (ORDER BY date)""")
def calendar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, next returns, gaps and weekdays."""
    return series.calendar_returns(_rates(spark, sf_dir)).select("date", _r("log_ret", 8), *[F.col(c).cast("double").alias(c) for c in ("direction", "direction_next", "gap_days")], _r("ret_next", 8), "dayofweek")


@query(f"WITH {_RATES} SELECT CAST(year(date) AS INT) AS year, CAST(round_even(avg(rate), 0) AS BIGINT) AS mean_rate FROM rates GROUP BY 1")
def yearly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rate per year, half-even."""
    return _rates(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.bround(F.avg("rate"), 0).cast("bigint").alias("mean_rate"))


@query(f"WITH {_SPLIT} SELECT date, target, rate_next, split FROM spl WHERE split IS NOT NULL")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological 80/10/10 split with an embargo of one row."""
    return _split(spark, sf_dir).select("date", "target", "rate_next", "split")


@query("""WITH n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM daily_kurs_split WHERE split = 'train'),
e AS (SELECT n.*, f AS fold, floor(n / 11) AS s FROM n, range(1, 11) t(f)), p AS (SELECT *, n - s * (10 - fold + 1) AS st FROM e)
SELECT CAST(fold AS INT) AS fold, CASE WHEN i < st - 1 THEN 'train' ELSE 'val' END AS part, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM p WHERE i < st - 1 OR (i >= st AND i < st + s) GROUP BY 1, 2""")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten expanding folds with a gap of one, inside train."""
    folds = series.expanding_folds(_days(spark, sf_dir).filter("split = 'train'").select("date"))
    return folds.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("SELECT split, min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM daily_kurs_split GROUP BY split")
def split_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day, last day and size per split."""
    return _days(spark, sf_dir).groupBy("split").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*) FILTER (target = 'NAIK') AS \"NAIK\", count(*) FILTER (target = 'STABIL') AS \"STABIL\", count(*) FILTER (target = 'TURUN') AS \"TURUN\" FROM daily_kurs_split GROUP BY split")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per split, pivoted."""
    return _days(spark, sf_dir).groupBy("split").pivot("target", list(LABELS)).count().fillna(0)


@query(f"WITH {_PERSIST} SELECT date, split, target, prediction FROM prd")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's label as the prediction."""
    return _persistence(spark, sf_dir).select("date", "split", "target", "prediction")


@query(f"WITH {_SPLIT}, m AS (SELECT target AS prediction FROM spl WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT split, target, prediction, count(*) AS n FROM spl, m WHERE split IS NOT NULL GROUP BY 1, 2, 3")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label of train as the prediction."""
    return series.majority(_split(spark, sf_dir)).groupBy("split", "target", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PERSIST}, {_CELLS} SELECT split, y_true, y_pred, n FROM cells")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion cells of the persistence prediction, zeros included."""
    return metrics.confusion(_persistence(spark, sf_dir), "target", "prediction", LABELS, ("split",))


@query(f"WITH {_PERSIST}, {_CLASSES} SELECT split, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM sc")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support per label."""
    cells = metrics.confusion(_persistence(spark, sf_dir), "target", "prediction", LABELS, ("split",))
    return metrics.per_class(cells, ("split",)).select("split", "label", _r("precision"), _r("recall"), _r("f1"), "support")


@query(f"""WITH {_PERSIST}, {_CLASSES}, t AS (SELECT split, sum(support) AS n, sum(hit) AS h, sum(support * predicted) AS sp, avg(CASE WHEN support > 0 THEN r END) AS ba, avg(f1) AS mf, sum(f1 * support) AS wf FROM sc GROUP BY 1)
SELECT split, round(h / n, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round(mf, 6) AS macro_f1, round(wf / n, 6) AS weighted_f1, round((h / n - sp / (n * n)) / (1 - sp / (n * n)), 6) AS kappa FROM t""")
def persistence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1 and kappa of the persistence prediction per split."""
    cells = metrics.confusion(_persistence(spark, sf_dir), "target", "prediction", LABELS, ("split",))
    out = metrics.classification(cells, ("split",))
    return out.select("split", *[_r(c) for c in out.columns if c != "split"])


@query(f"""WITH {_SPLIT} SELECT split, round(sqrt(avg(power(rate - rate_next, 2))), 6) AS rmse, round(avg(abs(rate - rate_next)), 6) AS mae, round(avg(abs((rate - rate_next) / rate_next)) * 100, 6) AS mape,
round(avg(CAST(sign(rate - rate) = sign(rate_next - rate) AS INT)), 6) AS directional_hit FROM spl WHERE split IS NOT NULL GROUP BY split""")
def random_walk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of today's rate as tomorrow's."""
    out = metrics.regression(_split(spark, sf_dir), "rate_next", "rate", "rate", ("split",))
    return out.select("split", *[_r(c) for c in out.columns if c != "split"])


@query("""SELECT split, round(1 - sqrt(avg(power(kurs_jisdor * (1 + ret_lag1) - kurs_besok, 2))) / sqrt(avg(power(kurs_jisdor - kurs_besok, 2))), 6) AS skill,
round(avg(CAST(sign(ret_lag1) = sign(kurs_besok - kurs_jisdor) AS INT)), 6) AS directional_hit FROM daily_kurs_split WHERE ret_lag1 IS NOT NULL AND kurs_besok IS NOT NULL GROUP BY split""")
def skill_vs_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill of continuing the last return against the random walk."""
    df = _days(spark, sf_dir).dropna(subset=["ret_lag1", "kurs_besok"])
    ours = metrics.regression(df.withColumn("pred", F.col("kurs_jisdor") * (1 + F.col("ret_lag1"))), "kurs_besok", "pred", "kurs_jisdor", ("split",))
    naive = metrics.regression(df, "kurs_besok", "kurs_jisdor", "kurs_jisdor", ("split",)).select("split", F.col("rmse").alias("naive"))
    return ours.join(naive, "split").select("split", F.round(metrics.skill(F.col("rmse"), F.col("naive")), 6).alias("skill"), _r("directional_hit"))


@query("SELECT target, count(*) AS n, round((SELECT count(*) FROM daily_kurs_split WHERE target IS NOT NULL) / (3.0 * count(*)), 6) AS weight FROM daily_kurs_split WHERE target IS NOT NULL GROUP BY target")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights."""
    return metrics.class_weights(_days(spark, sf_dir), "target").select("target", "n", _r("weight"))


@query("""WITH b AS (SELECT ret_std5 AS a, delta_besok AS b FROM daily_kurs_split WHERE split = 'train' AND ret_std5 IS NOT NULL AND delta_besok IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b)
SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of volatility and tomorrow's change on train."""
    return metrics.spearman(_days(spark, sf_dir).filter("split = 'train'"), "ret_std5", "delta_besok").select(_r("spearman"), "n")


@query("SELECT split, round(corr(ret_lag1, delta_besok), 6) AS pearson FROM daily_kurs_split WHERE ret_lag1 IS NOT NULL AND delta_besok IS NOT NULL GROUP BY split HAVING count(*) > 2")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with guards against few rows and no variance."""
    return _days(spark, sf_dir).groupBy("split").agg(F.round(metrics.guarded_correlation(F.col("ret_lag1"), F.col("delta_besok")), 6).alias("pearson"))


@query("""WITH q AS (SELECT quantile_cont(ret_std5, 0.75) AS hi, quantile_cont(ret_std5, 0.25) AS lo FROM daily_kurs_split)
SELECT CASE WHEN ret_std5 >= hi THEN 'high' WHEN ret_std5 <= lo THEN 'low' ELSE 'medium' END AS regime, count(*) AS n, round(avg(delta_besok), 6) AS mean_delta FROM daily_kurs_split, q WHERE ret_std5 IS NOT NULL GROUP BY 1""")
def volatility_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by quartile of volatility."""
    return metrics.regimes(_days(spark, sf_dir), "ret_std5").filter("regime is not null").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta_besok"), 6).alias("mean_delta"))


_TWO = """
two AS (SELECT date, split, target, CASE WHEN ret_lag1 > 0 THEN 'NAIK' ELSE 'TURUN' END = target AS base_ok, CASE WHEN log_return > 0 THEN 'NAIK' ELSE 'TURUN' END = target AS cand_ok
        FROM daily_kurs_split WHERE target IS NOT NULL AND ret_lag1 IS NOT NULL AND log_return IS NOT NULL)
"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).dropna(subset=["target", "ret_lag1", "log_return"])
    sign = lambda c: F.when(F.col(c) > 0, "NAIK").otherwise("TURUN") == F.col("target")
    base = days.select("date", "split", sign("ret_lag1").alias("ok"))
    cand = days.select("date", sign("log_return").alias("ok"))
    return joins.compare(base.select("date", "split", "ok"), cand, ["date"], ["ok"]).join(base.select("date", "split"), "date")


@query(f"WITH {_TWO} SELECT split, count(*) FILTER (NOT base_ok AND cand_ok) AS helped, count(*) FILTER (base_ok AND NOT cand_ok) AS hurt, count(*) FILTER (base_ok AND cand_ok) AS both_right, count(*) FILTER (NOT base_ok AND NOT cand_ok) AS both_wrong FROM two GROUP BY split")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one simple rule helps or hurts against another."""
    return metrics.contingency(_two(spark, sf_dir), "ok_base", "ok_cand", ("split",)).drop("p")


@query(f"""WITH {_TWO}, c AS (SELECT split, count(*) FILTER (NOT base_ok AND cand_ok) AS h, count(*) FILTER (base_ok AND NOT cand_ok) AS u FROM two GROUP BY split),
n AS (SELECT *, h + u AS n, least(h, u) AS k FROM c)
SELECT split, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) FROM range(0, 2000) t(i) WHERE i <= k)) END, 6) AS p FROM n""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact two-sided test of the two rules."""
    return metrics.contingency(_two(spark, sf_dir), "ok_base", "ok_cand", ("split",)).select("split", _r("p"))


_PROBS = """
probs AS (SELECT date, split, target, 1 / (1 + exp(-200 * ret_lag1)) AS a1, 0.3 AS a2, 1 / (1 + exp(200 * ret_lag1)) AS a3, 1 / (1 + exp(-200 * log_return)) AS b1, 0.5 AS b2, 1 / (1 + exp(200 * log_return)) AS b3
          FROM daily_kurs_split WHERE target IS NOT NULL AND ret_lag1 IS NOT NULL AND log_return IS NOT NULL)
"""


@query(f"""WITH {_PROBS}, g AS (SELECT p.*, i / 20.0::DOUBLE AS w FROM probs p, range(0, 21) t(i)),
m AS (SELECT split, w, target, w * a1 + (1 - w) * b1 AS s1, w * a2::DOUBLE + (1 - w) * b2::DOUBLE AS s2, w * a3 + (1 - w) * b3 AS s3 FROM g),
p AS (SELECT split, w, target, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'NAIK' WHEN s2 >= s3 THEN 'STABIL' ELSE 'TURUN' END AS pred FROM m),
l AS (SELECT unnest(['NAIK', 'STABIL', 'TURUN']) AS l),
f AS (SELECT split, w, l, coalesce(2.0 * count(*) FILTER (target = l AND pred = l) / nullif(count(*) FILTER (target = l) + count(*) FILTER (pred = l), 0), 0) AS f1 FROM p, l GROUP BY 1, 2, 3)
SELECT split, round(w, 2) AS w, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1, 2""")
def fusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of two sets of probabilities mixed with 21 weights, in one job."""
    days = _days(spark, sf_dir).dropna(subset=["target", "ret_lag1", "log_return"])
    p = lambda c, s: 1 / (1 + F.exp(s * 200 * F.col(c)))
    probs = days.select("split", "target", p("ret_lag1", -1).alias("a1"), F.lit(0.3).alias("a2"), p("ret_lag1", 1).alias("a3"), p("log_return", -1).alias("b1"), F.lit(0.5).alias("b2"), p("log_return", 1).alias("b3"))
    return metrics.fusion_grid(probs, "split", "target", ("a1", "a2", "a3"), ("b1", "b2", "b3"), LABELS).select("split", F.round("w", 2).alias("w"), _r("macro_f1"))


@query("WITH s AS (SELECT date, split, lead(date) OVER (ORDER BY date) AS news_date, lead(split) OVER (ORDER BY date) AS nx FROM daily_kurs_split) SELECT date, split, news_date FROM s WHERE nx = split")
def news_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next day's news, the last row of each split dropped."""
    return series.next_row_within_split(_days(spark, sf_dir).select("date", "split"))


_CALENDAR = """
h AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-15']) AS day),
cal AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-12-25', DATE '2024-02-20', INTERVAL 1 DAY) t(d)),
opn AS (SELECT c.day, isodow(c.day) < 6 AND h.day IS NULL AS is_open FROM cal c LEFT JOIN h ON h.day = c.day),
nxt AS (SELECT day, is_open, (SELECT min(o.day) FROM opn o WHERE o.is_open AND o.day >= opn.day) AS next_open FROM opn)
"""


def _calendar(spark: SparkSession) -> DataFrame:
    closed = spark.createDataFrame([(d,) for d in HOLIDAYS], "day string").select(F.to_date("day").alias("day"))
    return calendar.trading_calendar(spark, "2023-12-25", "2024-02-19", closed)


@query(f"WITH {_CALENDAR} SELECT day, is_open, next_open FROM nxt")
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open days of a bounded range and the next one of each day."""
    return _calendar(spark)


_ALIGNED = _CALENDAR + """,
al AS (SELECT e.*, n2.next_open AS trading_date FROM events e JOIN nxt n1 ON n1.day = CAST(e.ts AS DATE)
       JOIN nxt n2 ON n2.day = CAST(e.ts AS DATE) + CASE WHEN n1.is_open AND hour(e.ts) >= 16 THEN 1 ELSE 0 END)
"""


def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.align(table(spark, sf_dir, "events"), _calendar(spark), F.col("ts"))


@query(f"WITH {_ALIGNED} SELECT event_id, trading_date FROM al")
def trading_date_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's trading day, with a 16:00 cut-off."""
    return aligned_events(spark, sf_dir).select("event_id", "trading_date")


@query(f"WITH {_ALIGNED} SELECT trading_date, count(*) AS n_articles, round(avg(value), 6) AS score_mean, round(min(value), 6) AS score_min, round(avg(CAST(value <= -0.05 AS INT)), 6) AS neg_share FROM al GROUP BY 1")
def daily_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per trading day."""
    from tidewire.operators.features import daily_aggregate as agg

    out = agg(aligned_events(spark, sf_dir), "trading_date", "value")
    return out.select("trading_date", "n_articles", _r("score_mean"), _r("score_min"), _r("neg_share"))


@query(f"WITH {_ALIGNED}, w AS (SELECT trading_date, value, epoch(CAST(trading_date AS TIMESTAMP) + INTERVAL 16 HOUR - ts) / 3600.0 AS h FROM al) SELECT trading_date, round(sum(exp(-h / 24) * value) / sum(exp(-h / 24)), 6) AS score_w, round(avg(h), 6) AS mean_hours FROM w GROUP BY 1")
def recency_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per trading day, later ones weighing more."""
    from tidewire.operators.features import recency_weighted as weigh

    close = F.unix_timestamp(F.col("trading_date").cast("timestamp")) + 16 * 3600
    hours = aligned_events(spark, sf_dir).withColumn("h", (close - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 3600.0)
    return weigh(hours, "trading_date", "h", "value").select("trading_date", _r("score_w"), _r("mean_hours"))


@query("SELECT CAST(s AS DATE) AS start, least(CAST(s AS DATE) + 7, DATE '2024-03-05') AS \"end\", q AS query FROM range(DATE '2024-01-01', DATE '2024-03-05', INTERVAL 7 DAY) t(s), (SELECT DISTINCT query AS q FROM cnbc_discovered)")
def query_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open search windows of a week for every query."""
    queries = table(spark, sf_dir, "cnbc_discovered").select("query").distinct()
    return queries.crossJoin(F.broadcast(calendar.windows(spark, "2024-01-01", "2024-03-05")))


@query("WITH e(day, name) AS (VALUES (DATE '2022-02-24', 'invasion'), (DATE '2024-04-14', 'strike'), (DATE '2025-04-02', 'tariffs')) SELECT name, day, kurs_jisdor AS rate FROM e LEFT JOIN daily_kurs_split ON date = day")
def event_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate on dated events; null where there is none."""
    events = spark.createDataFrame([("2022-02-24", "invasion"), ("2024-04-14", "strike"), ("2025-04-02", "tariffs")], "d string, name string").select(F.to_date("d").alias("day"), "name")
    days = _days(spark, sf_dir).select(F.col("date").alias("day"), F.col("kurs_jisdor").alias("rate"))
    return days.join(F.broadcast(events), "day", "right").select("name", "day", "rate")


@query("""WITH a AS (SELECT try_cast(news_date_wib AS DATE) AS d, count(*) AS n FROM articles_aligned GROUP BY 1)
SELECT k.date, k.split, coalesce(n, 0) AS n_articles, CAST(n IS NULL AS INT) AS no_news FROM daily_kurs_split k LEFT JOIN a ON a.d = k.date""")
def no_news_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day once with its number of articles and a flag where there are none."""
    news = table(spark, sf_dir, "articles_aligned").groupBy(F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n_articles"))
    days = joins.onto_spine(_days(spark, sf_dir).select("date", "split"), news.filter("date is not null"), ["date"], {"n_articles": 0})
    return days.withColumn("no_news", (F.col("n_articles") == 0).cast("int"))


@query("SELECT split, count(*) AS no_news FROM daily_kurs_split WHERE date NOT IN (SELECT try_cast(news_date_wib AS DATE) FROM articles_aligned WHERE news_date_wib IS NOT NULL) GROUP BY split")
def no_news_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without any article per split, by an anti-join."""
    news = table(spark, sf_dir, "articles_aligned").select(F.try_to_date("news_date_wib", "yyyy-MM-dd").alias("date")).filter("date is not null")
    return joins.not_yet_done(_days(spark, sf_dir), news, "date").groupBy("split").agg(F.count(F.lit(1)).alias("no_news"))


@query("""WITH u AS (SELECT split, 'ret_lag1' AS feature, ret_lag1 AS x FROM daily_kurs_split UNION ALL SELECT split, 'ret_std5', ret_std5 FROM daily_kurs_split UNION ALL SELECT split, 'log_return', log_return FROM daily_kurs_split)
SELECT split, feature, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std, round(min(x), 8) AS least, round(quantile_cont(x, 0.5), 8) AS median, round(max(x), 8) AS most FROM u GROUP BY 1, 2""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of features per split, from an unpivot."""
    long = _days(spark, sf_dir).unpivot(["split"], ["ret_lag1", "ret_std5", "log_return"], "feature", "x")
    return long.groupBy("split", "feature").agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_samp("x"), 8).alias("std"), F.round(F.min("x"), 8).alias("least"),
        F.round(F.percentile("x", F.lit(0.5)), 8).alias("median"), F.round(F.max("x"), 8).alias("most"),
    )


@query("""WITH v AS (SELECT label AS i, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1), c AS (SELECT i, sum(n) OVER (ORDER BY n DESC, i) / sum(n) OVER () AS cum, row_number() OVER (ORDER BY n DESC, i) AS k FROM v)
SELECT k, round(cum, 6) AS cumulative, (SELECT min(k) FROM c WHERE cum >= 0.8) AS needed FROM c""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulated shares and how many components reach 0.8."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), "label")
    c = v.select(F.row_number().over(w).cast("bigint").alias("k"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("cum"))
    need = c.filter("cum >= 0.8").agg(F.min("k").alias("needed"))
    return c.crossJoin(F.broadcast(need)).select("k", F.round("cum", 6).alias("cumulative"), "needed")
