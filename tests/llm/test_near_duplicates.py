from __future__ import annotations

import random

import numpy as np
import pytest

from tidewire.llm import near_duplicates as nd

SCHEMA = "id bigint, text string, key string, bands string"


def articles(seed: int = 3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(60, 200))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + [out[0], out[0].upper(), "short text", "", None]


def brute(texts, exact, least, size, similarity):
    sets = {i: exact(t) for i, t in enumerate(texts) if t is not None and size(t) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


def pairs(spark, texts, kind):
    df = spark.createDataFrame([(i, t, "k", "b") for i, t in enumerate(texts)], SCHEMA)
    members, links = nd.linked_representatives(df, "id", "text", kind)
    return {tuple(r) for r in nd.all_pairs(members, links).collect()}, members, links


def test_bodies_against_brute_force(spark):
    texts = articles()
    got, members, links = pairs(spark, texts, nd.BODIES)
    assert got == brute(texts, lambda t: nd._word_set(t, 3), 60, lambda t: len(nd.words_of(t)), 0.6)
    per = nd.groups(members, links)
    assert per.count() == members.count() and per.filter("rep > key").count() == 0


def test_titles_against_brute_force(spark):
    rng = random.Random(5)
    base = [f"{a} bank {v} {b} pact as rate bets shift again" for a in ("Glohia", "Tesitho", "Kladro") for v in ("questions", "backs") for b in ("Jothosko", "Sinu", "Lema")]
    texts = base + [b.replace("rate", rng.choice(["rates", "rate", "late"])) + rng.choice(["", ".", " now"]) for b in base * 3]
    got, _, _ = pairs(spark, texts, nd.TITLES)
    assert got == brute(texts, lambda t: nd._char_set(t, 3), 20, lambda t: len(nd.title_of(t)), 0.8)


def test_overfull_buckets_lose_no_pair(spark):
    """With every bucket of more than one text taken as hot, prefix filtering finds the same pairs."""
    from dataclasses import replace

    texts = articles(9)
    df = spark.createDataFrame([(i, t, "k", "b") for i, t in enumerate(texts) if t], SCHEMA)
    members = df.selectExpr("id as key")
    cand = {tuple(r) for r in nd._pairs_of_hot(members, df.selectExpr("id as key", "text"), replace(nd.BODIES, hot=0)).collect()}
    want = brute(texts, lambda t: nd._word_set(t, 3), 60, lambda t: len(nd.words_of(t)), 0.6)
    assert want <= cand


def test_copies_stay_linear(spark):
    texts = ["same words " * 40 + str(i % 2) for i in range(300)]
    df = spark.createDataFrame([(i, t, "k", "b") for i, t in enumerate(texts)], SCHEMA)
    members, links = nd.linked_representatives(df, "id", "text", nd.BODIES)
    assert members.count() == 300 and members.select("rep").distinct().count() == 2 and links.count() <= 1


@pytest.mark.parametrize("weight", [1.0, 1.7, 0.4])
def test_signatures_estimate_weighted_similarity(weight):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:120], rng.integers(0, 2**63, 80).astype(np.uint64)])
    s = nd.dart_signatures(np.concatenate([a, b]), np.full(400, weight), np.array([0, 200, 400]), 2000)
    assert abs((s[0] == s[1]).mean() - 120 / 280) < 0.05
    heavy = np.concatenate([np.full(120, 3.0), np.full(80, 0.5)])
    s = nd.dart_signatures(np.concatenate([a, b]), np.concatenate([heavy, heavy]), np.array([0, 200, 400]), 2000)
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.05


def test_empty(spark):
    got, members, _ = pairs(spark, ["x"], nd.BODIES)
    assert got == set() and members.count() == 0


def test_a_key_with_two_texts_keeps_the_links_of_both(spark):
    one, other = "alpha beta gamma delta " * 3 + " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(90))
    rows = [(1, one, "k", "b"), (5, one, "k", "b"), (5, other, "k", "b"), (9, other + " end", "k", "b"), (9, other + " end", "k", "b"), (12, one + " end", "k", "b")]
    members, links = nd.linked_representatives(spark.createDataFrame(rows, SCHEMA), "id", "text", nd.BODIES)
    assert {tuple(r) for r in nd.all_pairs(members, links).collect()} == {(1, 5), (5, 9), (1, 12), (5, 12)}
    assert sorted(tuple(r) for r in nd.groups(members, links).collect()) == [(1, 1, 1), (5, 1, 1), (5, 5, 1), (9, 9, 1), (9, 9, 1), (12, 12, 1)]
