"""Registered queries of the timestamp dictionary (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.timestamps import TimestampDictionary, utc_text, with_site_clock
from tidewire.runtime import new_folder, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_site_clock(table(spark, sf_dir, "scrape_article"), table(spark, sf_dir, "site_clock"), "article_id", "url", "date_published")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles_aligned").select(F.col("aligned_id"), F.col("trading_date").alias("raw"), F.lit(None).cast("string").alias("zone_name"), F.lit(False).alias("day_first"))


def _normal(instants: DataFrame, dates: DataFrame) -> DataFrame:
    instants, dates = instants.filter("instant_us is not null"), dates.filter("day is not null")
    return instants.select(F.lit("scrape_article").alias("src"), F.col("article_id").alias("row_id"), utc_text(F.col("instant_us")).alias("normal_value")).unionByName(
        dates.select(F.lit("articles_aligned").alias("src"), F.col("aligned_id").alias("row_id"), F.col("day").cast("string").alias("normal_value"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that denotes a time, as one UTC instant or one Jakarta day."""
    return _normal(TimestampDictionary(spark).normalise(_pages(spark, sf_dir), "article_id"), TimestampDictionary(spark).normalise(_days(spark, sf_dir), "aligned_id"))


def p1_in_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from dictionaries that a first run filled with a third of the rows and a second one completes."""

    def resumed(rows: DataFrame, key: str) -> DataFrame:
        path = new_folder(spark, "timestamps")
        TimestampDictionary(spark, path).update(rows.filter(F.pmod(F.col(key), F.lit(3)) == 0))
        return TimestampDictionary(spark, path).normalise(rows, key)

    return _normal(resumed(_pages(spark, sf_dir), "article_id"), resumed(_days(spark, sf_dir), "aligned_id"))


def best_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own time, else the feed's, in any style, as one UTC instant."""
    articles = table(spark, sf_dir, "scrape_article")
    feed = articles.select("article_id", F.col("discovery_published").alias("raw"), F.lit("UTC").alias("zone_name"), F.lit(False).alias("day_first"))
    own = TimestampDictionary(spark).normalise(_pages(spark, sf_dir), "article_id").filter("instant_us is not null").select("article_id", F.col("instant_us").alias("own"))
    found = TimestampDictionary(spark).normalise(feed, "article_id").filter("instant_us is not null").select("article_id", F.col("instant_us").alias("feed"))
    both = own.join(found, "article_id", "full")
    return both.select("article_id", utc_text(F.coalesce("own", "feed")).alias("published"))


QUERIES = {"p1_found": p1_found, "p1_in_two": p1_in_two, "best_time": best_time}
