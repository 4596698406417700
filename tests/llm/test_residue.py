from __future__ import annotations

import pyarrow.parquet as pq
import pytest

from tidewire.llm import residue

SCHEMA = "article_id bigint, title string, body string, key string, in_title string"


@pytest.fixture(scope="module")
def rows(sf_dir):
    """Prose of the test tables, which hold no residue, and cases written by hand."""
    texts = pq.read_table(f"{sf_dir}/../sf0.01/documents.parquet", columns=["doc_id", "title", "text"]).to_pylist()
    out = [(r["doc_id"], r["title"], r["text"], "", "") for r in texts if r["text"].isascii() or "Ã" not in r["text"]]
    body = out[0][2]
    bad = [
        ("404", "404 – /some-story-here could not be found on this server.\nReturn to the front page."), ("A title", "Please enable JavaScript to view this page.\nYour browser does not run scripts, which this page requires."),
        ("A title", body + "\nThe ministry named {{ lead_para }} to lead the review."), ("${headline}", body), ("A title", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."),
        ("[INSERT HEADLINE]", body), ("A title", body + "\nRates stood at %RATE_CLOSE% early."), ("Just a moment...", "Checking that you are human before opening the page. This may take a few seconds."),
        ("Title", "Halaman tidak ditemukan.\nSilakan kembali ke beranda."), ("Title", "Too many requests from your network; slow down and reload the page."), (None, "502 Bad Gateway\nThe upstream server gave an invalid answer."),
    ]
    good = [("Bank error rates fell in June", body + "\n“Page not found” was the reply 616 importers got when the bank closed its register, the analyst said."), (None, None), ("", ""), ("The rupiah rose again in early trade", "The rupiah rose."), ("Bank warns over the rate memo", body + "\nHe said “[the governor] had not seen” the memo on the {0} rate.".replace("{0} ", ""))]
    return out, [(1000 + i, t, b, "", "") for i, (t, b) in enumerate(bad)], [(2000 + i, t, b, "", "") for i, (t, b) in enumerate(good)]


def test_held_out_cases(spark, rows):
    prose, bad, good = rows
    df = spark.createDataFrame(prose + bad + good, SCHEMA)
    got = {r["key"] for r in residue.residue(df).collect()}
    assert {k for k, *_ in bad} <= got
    assert not {k for k, *_ in good} & got
    assert len({k for k, *_ in prose} & got) <= len(prose) // 100


def test_long_repeated_and_empty(spark, rows):
    prose, bad, _ = rows
    df = spark.createDataFrame(prose + [bad[0], bad[0], (5000, "t", prose[0][2] * 200, "", "")], SCHEMA)
    got = [r["key"] for r in residue.residue(df).collect()]
    assert got.count(1000) == 2 and 5000 not in got
    assert residue.residue(df.limit(0)).count() == 0
