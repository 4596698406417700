"""Streaming forms of discovery, duplicate removal and calendar alignment.

Event columns without a zone are taken as UTC, because a watermark needs an
instant. Late data is dropped beyond the watermark. Aggregates are given out
once, when the watermark has passed their window, and their state is dropped
then; what is still open at the end is given out by an end mark beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.calendar import align


def stream_table(spark, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def with_instant(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``ts`` as an instant, with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def first_seen(df: DataFrame, key: str, ts: str, lateness: str = "8 days") -> DataFrame:
    """Each key once within the watermark."""
    return with_instant(df, ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, ts: str, value: str, width: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Counts and means over tumbling windows."""
    out = with_instant(df, ts, lateness).groupBy(F.window(ts, width)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def per_trading_day(df: DataFrame, calendar: DataFrame, ts: str, value: str, lateness: str = "1 day") -> DataFrame:
    """Scores per calendar day of publication and trading day; the calendar is a small static table.

    The day of publication bounds the state; a trading day of several days of
    news is summed up by :func:`trading_days`.
    """
    aligned = align(with_instant(df, ts, lateness), calendar, F.col(ts))
    out = aligned.groupBy(F.window(ts, "1 day"), "trading_date").agg(F.count(value).alias("n_articles"), F.sum(value).alias("score_sum"))
    return out.select(F.col("window.start").alias("day"), "trading_date", "n_articles", "score_sum")


def trading_days(parts: DataFrame) -> DataFrame:
    """``trading_date, n_articles, score_mean`` of what :func:`per_trading_day` gave out."""
    return parts.groupBy("trading_date").agg(F.sum("n_articles").alias("n_articles"), F.try_divide(F.sum("score_sum"), F.sum("n_articles")).alias("score_mean"))


def run_to_table(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, once, and stop; a restart goes on from the checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
