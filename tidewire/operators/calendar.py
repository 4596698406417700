"""Trading calendars and the alignment of timestamps to trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trading_calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """``day, is_open, next_open`` for every day of a bounded range; weekends and ``holidays (day)`` are closed."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    closed = (holidays if holidays is not None else spark.createDataFrame([], "day date")).select("day", F.lit(True).alias("closed")).distinct()
    marked = days.join(F.broadcast(closed), "day", "left").withColumn("is_open", (F.weekday("day") < 5) & F.col("closed").isNull()).drop("closed")
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return marked.withColumn("next_open", F.first(F.when(F.col("is_open"), F.col("day")), ignorenulls=True).over(ahead))


def align(df: DataFrame, calendar: DataFrame, ts: Column, cutoff_hour: int = 16) -> DataFrame:
    """Adds ``trading_date``: the day itself, or the next open one.

    A time at or after the cut-off of an open day belongs to the day after. The
    calendar is bounded by its range, so it is broadcast and nothing is shuffled.
    """
    opens = calendar.select(F.col("day").alias("_day"), F.col("is_open").alias("_open"))
    step = df.withColumn("_ts", ts).withColumn("_day", F.to_date("_ts")).join(F.broadcast(opens), "_day", "left")
    late = F.coalesce("_open", F.lit(False)) & (F.hour("_ts") >= cutoff_hour)
    step = step.withColumn("_from", F.when(late, F.date_add("_day", 1)).otherwise(F.col("_day")))
    target = calendar.select(F.col("day").alias("_from"), F.col("next_open").alias("trading_date"))
    return step.join(F.broadcast(target), "_from", "left").drop("_from", "_day", "_open", "_ts")


def windows(spark: SparkSession, first: str, last: str, days: int = 7) -> DataFrame:
    """Half-open windows ``start, end`` of ``days`` days, the last one clipped."""
    starts = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date_sub(date'{last}', 1), interval {days} day)")).alias("start"))
    return starts.select("start", F.least(F.date_add("start", days), F.lit(last).cast("date")).alias("end"))
