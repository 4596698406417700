"""Daily series: cleaning, changes, labels, splits and naive predictions.

Every frame here has one row per day, so a global order by date is a window
over a few thousand rows; raw events are aggregated to days first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("NAIK", "STABIL", "TURUN")


def parsed_day(text: Column) -> Column:
    """A day written month first with slashes, or in ISO order; null otherwise."""
    t = F.trim(text)
    slashes = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3)
    iso = F.concat_ws("-", slashes, F.lpad(F.regexp_extract(t, r"^(\d{1,2})/", 1), 2, "0"), F.lpad(F.regexp_extract(t, r"^\d{1,2}/(\d{1,2})/", 1), 2, "0"))
    return F.when(slashes != "", F.try_to_date(iso, "yyyy-MM-dd")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def clean_rates(raw: DataFrame, day: str, rate: str) -> DataFrame:
    """``date, rate``: one row per day, rows without a valid day or a positive rate dropped, repeated days averaged half-even."""
    parsed = raw.select(parsed_day(F.col(day)).alias("date"), F.trim(F.col(rate)).try_cast("double").alias("rate"))
    valid = parsed.filter(F.col("date").isNotNull() & (F.col("rate") > 0))
    return valid.groupBy("date").agg(F.bround(F.avg("rate"), 0).cast("bigint").alias("rate"))


def rejected_rates(raw: DataFrame, day: str, rate: str) -> DataFrame:
    """Counts of rows that :func:`clean_rates` drops, by reason."""
    parsed = raw.select(parsed_day(F.col(day)).alias("d"), F.trim(F.col(rate)).try_cast("double").alias("r"))
    return parsed.agg(
        F.count_if(F.col("d").isNull()).alias("bad_date"),
        F.count_if(F.col("d").isNotNull() & F.col("r").isNull()).alias("bad_rate"),
        F.count_if(F.col("d").isNotNull() & (F.col("r") <= 0)).alias("not_positive"),
    )


def label(change: Column, threshold: float = 0.1) -> Column:
    """Up, flat or down by a strict threshold in percent; null stays null."""
    return F.when(change > threshold, LABELS[0]).when(change < -threshold, LABELS[2]).when(change.isNotNull(), LABELS[1])


def changes(days: DataFrame, date: str = "date", rate: str = "rate", threshold: float = 0.1) -> DataFrame:
    """Adds ``pct_change``, tomorrow's ``target`` label, ``rate_next`` and ``delta_next``."""
    w = Window.orderBy(date)
    pct = (F.col(rate) / F.lag(rate).over(w) - 1) * 100
    step = days.withColumn("pct_change", pct).withColumn("_label", label(F.col("pct_change"), threshold))
    return step.select(*days.columns, "pct_change", F.lead("_label").over(w).alias("target"), F.lead(rate).over(w).alias("rate_next"), (F.lead(rate).over(w) - F.col(rate)).alias("delta_next"))


def with_target(df: DataFrame, rate: str, rate_next: str, threshold: float = 0.1) -> DataFrame:
    """Adds ``delta``, and ``target`` from tomorrow's rate if the table has none."""
    out = df.withColumn("delta", F.col(rate_next) - F.col(rate))
    return out if "target" in df.columns else out.withColumn("target", label((F.col(rate_next) / F.col(rate) - 1) * 100, threshold))


def lagged_returns(days: DataFrame, date: str = "date", rate: str = "rate", lags: int = 3, span: int = 5, shift: int = 0) -> DataFrame:
    """``log_return``, ``ret_lag1..`` and the sample deviation of the last ``span`` returns, null until there are that many.

    ``shift`` moves the lags back by as many days.
    """
    w = Window.orderBy(date)
    step = days.withColumn("log_return", F.ln(F.col(rate) / F.lag(rate).over(w)))
    frame = w.rowsBetween(1 - span, 0)
    deviation = F.when(F.count("log_return").over(frame) == span, F.stddev_samp("log_return").over(frame))
    return step.select(*step.columns, *[F.lag("log_return", i + shift).over(w).alias(f"ret_lag{i}") for i in range(1, lags + 1)], deviation.alias(f"ret_std{span}"))


def calendar_returns(days: DataFrame, date: str = "date", rate: str = "rate") -> DataFrame:
    """Log returns with direction, the next ones, and gaps between days."""
    w = Window.orderBy(date)
    step = days.withColumn("log_ret", F.ln(F.col(rate) / F.lag(rate).over(w))).withColumn("direction", F.when(F.col("log_ret").isNotNull(), (F.col("log_ret") > 0).cast("int")))
    return step.select(
        *step.columns, F.lead("log_ret").over(w).alias("ret_next"), F.lead("direction").over(w).alias("direction_next"),
        F.datediff(date, F.lag(date).over(w)).alias("gap_days"), F.weekday(date).alias("dayofweek"),
    )


def chronological_split(days: DataFrame, date: str = "date", train: float = 0.8, val: float = 0.1, embargo: int = 1) -> DataFrame:
    """Adds ``split`` by position in time; the last ``embargo`` rows of train and val are dropped."""
    if not (train > 0 and val > 0 and train + val < 1 and embargo >= 0):
        raise ValueError("shares must be positive and leave a test part")
    w = Window.orderBy(date)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    step = days.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    first, second = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + val))
    split = F.when(F.col("_i") < first - embargo, "train").when((F.col("_i") >= first) & (F.col("_i") < second - embargo), "val").when(F.col("_i") >= second, "test")
    return step.withColumn("split", split).filter("split is not null").drop("_i", "_n")


def expanding_folds(days: DataFrame, date: str = "date", folds: int = 10, gap: int = 1) -> DataFrame:
    """Rows of ``folds`` expanding windows: ``fold``, ``part`` (train or val)."""
    spark = days.sparkSession
    step = days.withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    size = F.floor(F.col("_n") / (folds + 1))
    each = step.crossJoin(F.broadcast(spark.range(folds).select((F.col("id") + 1).cast("int").alias("fold"))))
    start = F.col("_n") - size * (folds - F.col("fold") + 1)
    part = F.when(F.col("_i") < start - gap, "train").when((F.col("_i") >= start) & (F.col("_i") < start + size), "val")
    return each.withColumn("part", part).filter("part is not null").drop("_i", "_n")


def most_frequent(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent non-null value per group; the smallest of equally frequent ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias(value))


def persistence(days: DataFrame, date: str = "date", target: str = "target", split: str = "split") -> DataFrame:
    """Yesterday's label within the split; the split's own mode on its first row. Adds ``prediction``."""
    mode = most_frequent(days, target, split).withColumnRenamed(target, "_mode")
    lag = F.lag(target).over(Window.partitionBy(split).orderBy(date))
    return days.join(F.broadcast(mode), split).withColumn("prediction", F.coalesce(lag, "_mode")).drop("_mode")


def majority(days: DataFrame, target: str = "target", split: str = "split") -> DataFrame:
    """The mode of train as the prediction everywhere."""
    mode = most_frequent(days.filter(F.col(split) == "train"), target).withColumnRenamed(target, "prediction")
    return days.crossJoin(F.broadcast(mode))


def next_row_within_split(days: DataFrame, date: str = "date", split: str = "split") -> DataFrame:
    """Adds ``news_date``, the next day, and drops the last row of each split."""
    w = Window.orderBy(date)
    return days.withColumn("news_date", F.lead(date).over(w)).withColumn("_next", F.lead(split).over(w)).filter(F.col("_next") == F.col(split)).drop("_next")
