from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import packing


def check(histogram, capacity):
    made = packing.plan(histogram, capacity)
    counted, load = Counter(), Counter()
    for length, lo, hi, base, per in made.slots:
        assert (hi - lo) % per == 0
        counted[length] += hi - lo
        for c in range(base, base + (hi - lo) // per):
            load[c] += length * per
    assert counted == Counter({k: v for k, v in histogram.items() if v})
    assert not load or max(load.values()) <= capacity and len(load) == made.containers
    return made


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_hold_every_item(histogram):
    check(histogram, 40)


def test_known_optimum():
    made = check({6: 30, 4: 30, 5: 20}, 10)
    assert made.containers == 40


@pytest.mark.parametrize("capacity", [64, 700])
def test_little_room_is_unused(capacity):
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(3, 0.8, 4000).astype(int), 1, capacity)
    made = check(dict(Counter(map(int, sizes))), capacity)
    assert sizes.sum() / (made.containers * capacity) > 0.97


def test_pricing_against_enumeration():
    sizes, values = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.2])
    got = packing.price(values, sizes, 17)
    best = max(a * 3.1 + b * 5.6 + c * 7.2 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert abs(got @ values - best) < 1e-9 and got @ sizes <= 17


def test_assignment(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 10, 10, 10, 25, 20, 3, 3, 3, 3, 3, 3, 3] + [7] * 200)]
    sizes = spark.createDataFrame(rows + [(3, 10)], "key bigint, tokens bigint")
    specs = spark.createDataFrame([("ten", 10), ("wide", 100), ("none", 0)], "spec_name string, capacity_tokens int")
    out = [r.asDict() for r in packing.pack(sizes, specs).collect()]
    for spec, capacity in (("ten", 10), ("wide", 100)):
        mine = [r for r in out if r["spec_name"] == spec]
        load = Counter()
        for r in mine:
            load[r["container_id"]] += r["tokens"]
        assert load.pop(None) == 0 and max(load.values()) <= capacity and set(load) == set(range(len(load)))
        total = Counter()
        for r in mine:
            total[r["key"]] += r["tokens"]
        assert total == Counter(dict(rows)) + Counter({3: 10}) or total[3] == 20
    pieces = [r for r in out if r["spec_name"] == "ten" and r["key"] == 5]
    assert sorted(r["tokens"] for r in pieces) == [5, 10, 10]
    assert packing.pack(sizes.limit(0), specs).count() == 0 and packing.pack(sizes, specs.limit(0)).count() == 0
