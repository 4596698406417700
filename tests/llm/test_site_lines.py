from __future__ import annotations

from collections import defaultdict

from tidewire.llm import site_lines

SCHEMA = "article_id bigint, url string, body string, site string, line_no string"


def brute(rows, least):
    docs, at = defaultdict(set), []
    for key, url, body, *_ in rows:
        if key is None or url is None or body is None:
            continue
        site = url.split("/")[2].lower().removeprefix("www.").removeprefix("m.")
        for no, line in enumerate(body.split("\n"), 1):
            if norm := " ".join(line.split()).lower():
                docs[site, norm].add(key)
                at.append((key, no, site, norm))
    return {(k, n) for k, n, s, x in at if len(docs[s, x]) >= least}


def test_against_brute_force(spark):
    long = "word " * 20_000
    rows = [(i, f"https://{'www.' if i % 2 else 'm.'}A.example/{i}", f"Own {i}\n\nSHARE  this story\r\nshare This story\n{long if i < 3 else ''}", "x", "y") for i in range(1, 9)]
    rows += [(40_000 * i, "https://b.example/x", "Share this story", "x", "y") for i in range(1, 4)]
    rows += [(9, None, "Share this story", "x", "y"), (10, "https://a.example/", None, "x", "y"), (11, "https://a.example/", "", "x", "y"), (1, "https://a.example/", "Share this story", "x", "y"), (None, "https://a.example/", "share this story", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (2, 3, 8, 9):
        got = {tuple(r) for r in site_lines.repeated_lines(df, least=least).collect()}
        assert got == brute(rows, least), least


def test_bodies_without_lines(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "keep\nshare\nkeep", "", ""), (2, "https://a.example/", "share", "", ""), (3, None, None, "", "")], SCHEMA)
    lines = site_lines.repeated_lines(df, least=2)
    assert {r[0]: r[1] for r in site_lines.without_lines(df, lines).collect()} == {1: "keep\nkeep", 2: "", 3: None}


def test_empty_table(spark):
    assert site_lines.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_documents_in_one_range(spark, monkeypatch):
    """Containers of offsets and of bits stand side by side and count alike."""
    rows = [(i, "https://a.example/", "Share this\n" + ("share  THIS" if i % 3 else f"own {i % 40}"), "", "") for i in range(300)] + [(40_000 + i, "https://a.example/", "share this", "", "") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for sparse in (2048, 50, 0):
        monkeypatch.setattr(site_lines, "SPARSE", sparse)
        for least in (3, 100, 304, 305):
            assert {tuple(r) for r in site_lines.repeated_lines(df, least=least).collect()} == brute(rows, least), (sparse, least)
