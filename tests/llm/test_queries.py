"""Queries of the language-model operators against their SQL."""

from __future__ import annotations

import pytest

from tests.conftest import plain, rows_of
from tidewire.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    got = queries.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert rows_of(got) == sorted(tuple(plain(v) for v in r) for r in want)


def test_bodies_lose_what_is_no_article(spark, sf_dir):
    found = queries.p4_found(spark, sf_dir)
    kept = queries.p4_bodies(spark, sf_dir).filter("body is not null")
    lines = spark.read.parquet(f"{sf_dir}/scrape_article.parquet").filter("body is not null")
    count = lambda df: df.selectExpr("sum(size(filter(split(body, '\\n'), x -> trim(x) <> ''))) as n").first()["n"]
    gone = found.join(lines, "article_id", "left_semi").count()
    assert count(lines) - count(kept) == gone > 0


def test_shares_of_the_mixture(spark, sf_dir):
    for r in queries.p9_shares(spark, sf_dir).filter("target_share > 0").collect():
        # A hundred documents can be no closer.
        assert abs(r["actual_share"] - r["target_share"]) < 0.06 and abs(r["expected_share"] - r["actual_share"]) < 1e-4
        assert r["most"] <= r["max_repeats"]
