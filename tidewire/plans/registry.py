"""All queries outside the language-model subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans import article_queries, model_queries, series_queries, text_queries, times

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**times.QUERIES, **series_queries.QUERIES, **text_queries.QUERIES, **article_queries.QUERIES, **model_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**series_queries.SQL, **text_queries.SQL, **article_queries.SQL, **model_queries.SQL}
