"""Feeds and pages by address, as data sources that give rows instead of errors.

Any address that Python can open works, local files among them; each address is
a partition of its own, so that a slow one holds up nothing but its task.
"""

from __future__ import annotations

import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.sources.files import scraped


def feed_url(query: Column, start: Column, end: Column, base: str) -> Column:
    """The address of a search for ``query`` within a half-open window."""
    asked = F.concat_ws(" ", query, F.concat(F.lit("after:"), start.cast("string")), F.concat(F.lit("before:"), end.cast("string")))
    # Blanks are written as %20, which every server reads alike.
    return F.concat(F.lit(f"{base}?q="), F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20")), F.lit("&hl=en-US&gl=US&ceid=US:en"))


def _open(address: str, seconds: float) -> bytes:
    asked = urllib.request.Request(address, headers={"User-Agent": "Mozilla/5.0", "Accept-Language": "en-US,en;q=0.9"})
    with urllib.request.urlopen(asked, timeout=seconds) as answer:
        return answer.read()


class _Addresses(DataSource):
    """Options: ``addresses``, one a line, and ``seconds`` to wait for each."""

    def _listed(self) -> list[str]:
        return [a for a in self.options.get("addresses", "").split("\n") if a.strip()]


class _Reader(DataSourceReader):
    def __init__(self, addresses: list[str], seconds: float):
        self.addresses, self.seconds = addresses, seconds

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in self.addresses] or [InputPartition("")]


class _FeedReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        try:
            root = ET.fromstring(_open(partition.value, self.seconds))
        except Exception:  # a feed that can't be read has no items
            return
        text = lambda item, name: (item.findtext(name) or "").strip() or None
        for item in root.iter("item"):
            source = item.find("source")
            yield (text(item, "title"), text(item, "link"), text(item, "pubDate"), text(item, "source"), source.get("url") if source is not None else None, partition.value)


class FeedSource(_Addresses):
    """Items of feeds: ``title_rss, rss_link, published_rss, source, source_url, feed``; an unreadable feed is empty."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_feed"

    def schema(self) -> str:
        return "title_rss string, rss_link string, published_rss string, source string, source_url string, feed string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self._listed(), float(self.options.get("seconds", "30")))


class _PageReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        try:
            yield (partition.value, _open(partition.value, self.seconds).decode("utf-8", "replace"), None)
        except Exception as problem:
            yield (partition.value, None, str(problem)[:500] or type(problem).__name__)


class PageSource(_Addresses):
    """Pages: ``url, html, fetch_error``; an unreadable page has its error."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_page"

    def schema(self) -> str:
        return "url string, html string, fetch_error string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self._listed(), float(self.options.get("seconds", "30")))


def _read(spark: SparkSession, source: type[DataSource], addresses: list[str], seconds: float) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("addresses", "\n".join(addresses)).option("seconds", str(seconds)).load()


def read_feeds(spark: SparkSession, addresses: list[str], seconds: float = 30) -> DataFrame:
    """Items of feeds; one that can't be read has none."""
    return _read(spark, FeedSource, addresses, seconds)


def read_pages(spark: SparkSession, addresses: list[str], seconds: float = 30, least: int = 300) -> DataFrame:
    """``url, title, published_at, author, body, status, error`` of pages; never an exception."""
    pages = _read(spark, PageSource, addresses, seconds).dropDuplicates(["url"])
    fields = scraped(pages, "url", "html", least).withColumnRenamed("key", "url").withColumnRenamed("error", "_short")
    out = fields.join(pages.select("url", "fetch_error"), "url")
    failed = F.col("fetch_error").isNotNull()
    return out.select("url", "title", "published_at", "author", "body", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), F.coalesce("fetch_error", "_short").alias("error"))
