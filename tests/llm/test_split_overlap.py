from __future__ import annotations

import random

from tidewire.llm import near_duplicates as nd
from tidewire.llm import split_overlap

SCHEMA = "aligned_id bigint, body_clean string, split string, url string, key string, train string"


def corpus(seed: int = 4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        base = rng.choices(words, k=rng.randint(3, 120))
        rows.append([" ".join(base), "train"])
        if rng.random() < 0.5:
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append([" ".join(copy), rng.choice(["val", "test"])])
    rows += [[rows[0][0], "val"], [rows[0][0], "train"], [None, "val"], ["", "test"], ["one two", "val"], ["one two", "train"], [rows[1][0], None], ["word " * 30_000, "train"], ["word " * 30_000, "test"]]
    return [(i, t, s, f"https://s{i % 3}.example/", "k", "t") for i, (t, s) in enumerate(rows)]


def brute(rows):
    sets = {i: nd._word_set(t, 3) for i, t, s, *_ in rows if t is not None and s is not None}
    side = {i: s == "train" for i, _, s, *_ in rows}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and side[a] != side[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6:
                out.add((a, b))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    classes, links = split_overlap.overlaps(df)
    assert {tuple(r) for r in split_overlap.pairs_of_rows(classes, links).collect()} == brute(rows)


def test_many_shards_find_the_same(spark, monkeypatch):
    rows = corpus(8)
    monkeypatch.setattr(split_overlap, "SHARD", 50)
    monkeypatch.setattr(split_overlap, "BLOCK", 9000)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in split_overlap.pairs_of_rows(*split_overlap.overlaps(df)).collect()} == brute(rows)


def test_coverage_and_report(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, "train", "https://a.example/", "", ""), (2, text, "val", "https://a.example/", "", ""), (3, text + " tail of more", "val", None, "", "")], SCHEMA)
    classes, links = split_overlap.overlaps(df)
    assert {r["key"]: r["covered"] for r in split_overlap.covered_words(links).collect()} == {2: 50, 3: 50}
    got = {(r["split"], r["site"]): (r["rows"], r["pairs"], r["covered_words"]) for r in split_overlap.report(df, classes, links).collect()}
    assert got == {("val", "a.example"): (1, 1, 50), ("val", None): (1, 1, 50)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert split_overlap.pairs_of_rows(*split_overlap.overlaps(df)).count() == 0


def test_a_key_with_two_texts_keeps_the_links_of_both(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = [(1, one, "train"), (5, one, "train"), (5, other, "train"), (9, other + " end", "test"), (9, one, "val")]
    df = spark.createDataFrame([(k, t, s, None, "k", "t") for k, t, s in rows], SCHEMA)
    assert {tuple(r) for r in split_overlap.pairs_of_rows(*split_overlap.overlaps(df)).collect()} == {(5, 9), (1, 9)}


def _templated(n: int, seed: int = 3):
    """Texts of stock sentences with names and numbers, each name in ever more texts as there are more of them."""
    rng = random.Random(seed)
    stock = [[f"s{i}w{j}" for j in range(6)] for i in range(12)]
    rows = []
    for i in range(n):
        text = [w for s in rng.choices(stock, k=8) for w in (*s[:3], f"n{rng.randrange(40)}", *s[3:], str(rng.randrange(10**6)))]
        rows.append((i, " ".join(text), "test" if i % 3 == 0 else "train"))
        if i % 10 == 0:
            # A copy that lacks a fifth of the text, or has as much more.
            rows.append((n + i, " ".join(text[:50] if i % 20 else text + [f"x{i}y{j}" for j in range(15)]), "train" if i % 3 == 0 else "val"))
    return [(k, t, s, None, "k", "t") for k, t, s in rows]


def test_stock_sentences_are_not_matched_with_each_other(spark, monkeypatch):
    occurrences = []
    for n in (150, 600):
        rows = _templated(n)
        df = spark.createDataFrame(rows, SCHEMA)
        expected = brute(rows)
        assert len(expected) >= n // 10
        for shard, part in ((250_000, 32_000_000), (40, 20_000)):
            monkeypatch.setattr(split_overlap, "SHARD", shard)
            monkeypatch.setattr(split_overlap, "PART", part)
            assert {tuple(r) for r in split_overlap.pairs_of_rows(*split_overlap.overlaps(df)).collect()} == expected
        texts = df.selectExpr("aligned_id as key", "split = 'train' as is_train", "body_clean as text")
        passages = split_overlap.rare_passages(texts, 0.6).collect()
        held = [(s == "train", set(split_overlap.passages_of(t))) for _, t, s, *_ in rows]
        occurrences.append(sum(r["passage"] in own for r in passages for side, own in held if side != r["is_train"]))
    # Four times the texts: sixteen times the matches if every text's rarest passages are looked for.
    assert occurrences[1] < 7 * occurrences[0]
