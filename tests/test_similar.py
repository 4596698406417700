"""Pairs of similar vectors: few are compared, none is missed."""

from __future__ import annotations

import random

import duckdb

from tests.test_whole import stored
from tidewire.operators import joins
from tidewire.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_pairs_that_are_compared_are_few_and_none_is_missed(spark):
    rng = random.Random(7)
    vectors = []
    for i in range(300):
        # Some stock terms of nearly all the mass, in every fourth a changed copy of the one before.
        terms = {t: rng.uniform(0.2, 1) for t in rng.sample(range(200, 400), 30)} | {rng.randrange(200): 0.5}
        if i % 4 == 3:
            terms = {t: w * rng.uniform(0.5, 1.5) for t, w in vectors[-1].items()}
        norm = sum(w * w for w in terms.values()) ** 0.5
        vectors.append({t: w / norm for t, w in terms.items()})
    cosine = {(a, b): sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) for a in range(300) for b in range(a + 1, 300)}
    want = {p for p, x in cosine.items() if x >= 0.9}
    assert 20 < len(want) < 76
    df = spark.createDataFrame([(i, sorted(v), [v[t] for t in sorted(v)]) for i, v in enumerate(vectors)], "id bigint, t array<bigint>, w array<double>")
    compared = {tuple(r) for r in joins.candidates(df).collect()}
    assert want <= compared and len(compared) <= 80
    weights = spark.createDataFrame([(i, f"t{t}", w) for i, v in enumerate(vectors) for t, w in v.items()], "id bigint, term string, w double")
    got = {(r["a"], r["b"]): r["cosine"] for r in joins.similar_earlier(weights).collect()}
    assert set(got) == want and all(abs(x - cosine[p]) < 1e-9 for p, x in got.items())


def test_groups_of_postings_span_batches_and_blocks(spark):
    import pyarrow as pa

    rows = [(t, 1.0, bytes([255] + [0] * 127), t * 10 + i) for t, n in ((1, 1), (2, 5), (3, 1), (4, 3)) for i in range(n)]
    names = ["t", "mass", "parts", "id"]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [(x, y) for b in joins._meetings(0.9, 4)(iter(batches)) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
        assert sorted(got) == [(20 + i, 20 + j) for i in range(5) for j in range(i + 1, 5)] + [(40, 41), (40, 42), (41, 42)], size


def test_near_duplicates_of_odd_rows_equal_their_sql(spark, tmp_path):
    rng = random.Random(3)
    words = ["rate", "bank", "rupiah", "export", "tariff", "levy", "coal", "visa", "fund", "yield"]
    bodies = [" ".join(rng.choices(words, k=20)) + f" {'abcdefghij'[i % 10]}xq" for i in range(40)]
    rows = [(i, b) for i, b in enumerate(bodies)] + [(100 + i, b + " again") for i, b in enumerate(bodies[:9])]
    # Keys twice, texts without a word, no text, and copies.
    rows += [(1, bodies[2]), (5, None), (200, None), (201, ""), (202, "12 , 3"), (203, "12 , 3"), (204, bodies[7]), (205, bodies[7])]
    folder = stored(spark, tmp_path, "articles_aligned", [(i, b, "train", "2024-01-01") for i, b in rows], "aligned_id bigint, body_clean string, split string, news_date_wib string")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW articles_aligned AS SELECT * FROM '{folder}/articles_aligned.parquet/*.parquet'")
    for name in ("near_dup_cosine", "near_dup_dropped"):
        want = sorted(duck.sql(SQL[name]).fetchall())
        assert want and sorted(map(tuple, QUERIES[name](spark, folder).collect())) == want, name
