"""Items of varying length in containers of fixed capacity (problem 8).

The plan is made on the histogram of lengths, which is as long as the capacity
and does not grow with the items. A configuration says how many items of each
size class one container holds. The linear program over all configurations is
solved by multiplicative weights; a knapsack dynamic program prices the next
configuration. The solution is rounded down, what is left is packed by size,
and the smallest items, held back, fill the room that size classes left. The
plan is a table of rank ranges per length; items get their rank by counting and
their container by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut, small

#: Size classes of the linear program: capacities up to it are solved at their exact lengths.
UNITS = 256
#: Rounds of multiplicative weights with pricing, and over the configurations found.
ROUNDS, POLISH = 900, 4000
EPSILON = 0.15


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        best[room], took[room] = best[room - 1], -1
        if fit:
            gains = best[room - sizes[:fit]] + values[:fit]
            i = int(gains.argmax())
            if gains[i] > best[room] + 1e-15:
                best[room], took[room] = gains[i], i
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return counts


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, polish: int = POLISH) -> tuple[np.ndarray, np.ndarray]:
    """Configurations and how often to use each, so that they cover the demand: multiplicative weights on the covering program."""
    load = np.zeros(len(sizes))
    pool: dict[bytes, int] = {}
    columns: list[np.ndarray] = []

    def weights() -> np.ndarray:
        w = np.exp(-EPSILON * (load - load.min()) * 10)
        return w / demand

    for _ in range(rounds):
        counts = np.minimum(price(weights(), sizes, capacity), demand)
        if counts.tobytes() not in pool:
            pool[counts.tobytes()] = len(columns)
            columns.append(counts)
        ratio = counts / demand
        load += ratio / ratio.max() * 0.5
    matrix = np.array(columns, dtype=float)
    ratios = matrix / demand
    used, load, total = np.zeros(len(matrix)), np.zeros(len(sizes)), 0.0
    for step in range(polish):
        w = np.exp(-(load - load.min()) * 40 / max(1.0, load.mean() if step else 1.0))
        i = int((ratios @ w).argmax())
        size = 0.2 / ratios[i].max()
        used[i] += size
        load += ratios[i] * size
        total += size
    return matrix.astype(np.int64), used / max(load.min(), 1e-12)


@dataclass
class Plan:
    """Runs of equally filled containers, as rank ranges of each length."""

    capacity: int
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0

    def add(self, rank: dict[int, int], content: dict[int, int], times: int) -> None:
        """``times`` containers with ``content`` (length to count) each; ``rank`` is the next free rank of each length."""
        for length, count in content.items():
            self.slots.append((length, rank[length], rank[length] + count * times, self.containers, count))
            rank[length] += count * times
        self.containers += times


def _largest_first(left: dict[int, int], room: int, most: int) -> tuple[dict[int, int], int]:
    """Fill one container's room with the longest lengths that fit; returns the content and how often it can be repeated."""
    content: dict[int, int] = {}
    for length in sorted(left, reverse=True):
        if (n := min(room // length, left[length])) > 0:
            content[length] = n
            room -= n * length
    return content, min([most, *(left[x] // n for x, n in content.items())]) if content else 0


def _take(left: dict[int, int], content: dict[int, int], times: int) -> None:
    for length, n in content.items():
        left[length] -= n * times
        if not left[length]:
            del left[length]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Containers for ``histogram`` (length in 1..capacity to count). All work is bounded by the number of lengths."""
    made, rank = Plan(capacity), dict.fromkeys(histogram, 0)
    left = dict(histogram)
    if whole := left.pop(capacity, 0):
        made.add(rank, {capacity: 1}, whole)
    unit = -(-capacity // UNITS)
    room = capacity // unit
    tokens = sum(s * n for s, n in left.items())
    # Classes round up by half a unit a container's item on average; the smallest items fill that room later.
    sand: dict[int, int] = {}
    if unit > 1 and left:
        loss = unit / 2 * sum(left.values()) / tokens * 1.5 + 0.01
        held, keep = 0, min(loss, 0.5) * tokens
        for length in sorted(left):
            n = min(left[length], int((keep - held) // length))
            if n <= 0 or length > capacity // 4:
                break
            sand[length] = n
            held += n * length
            _take(left, {length: n}, 1)
    by_class: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        by_class.setdefault(-(-length // unit), []).append(length)
    sizes = np.array(sorted(c for c in by_class if c <= room), dtype=np.int64)
    runs: list[tuple[int, dict[int, int]]] = []
    if len(sizes):
        demand = np.array([sum(left[x] for x in by_class[c]) for c in sizes])
        configurations, times = fractional(sizes, demand.astype(float), room)
        for i in np.argsort(-times):
            content = {int(sizes[j]): int(n) for j, n in enumerate(configurations[i]) if n}
            have = {c: sum(left.get(x, 0) for x in by_class[c]) for c in content}
            todo = min([int(times[i]), *(have[c] // n for c, n in content.items())])
            while todo > 0:
                # Equal lengths as long as they last: a new run begins where one ends.
                exact: dict[int, int] = {}
                for c, n in content.items():
                    for x in by_class[c]:
                        if n and left.get(x, 0):
                            exact[x] = min(n, left[x])
                            n -= exact[x]
                same = min([todo, *(left[x] // n for x, n in exact.items())])
                _take(left, exact, same)
                runs.append((same, exact))
                todo -= same
    while left:
        content, times = _largest_first(left, capacity, max(left.values()))
        _take(left, content, times)
        runs.append((times, content))
    # The fullest runs last: large gaps take the longer of the held-back items.
    queue = sorted(runs, key=lambda r: sum(x * n for x, n in r[1].items()))
    for times, content in queue:
        gap = capacity - sum(x * n for x, n in content.items())
        while times:
            extra, can = _largest_first(sand, gap, times)
            can = can or times
            _take(sand, extra, can)
            made.add(rank, {x: content.get(x, 0) + extra.get(x, 0) for x in content | extra}, can)
            times -= can
    while sand:
        content, times = _largest_first(sand, capacity, max(sand.values()))
        _take(sand, content, times)
        made.add(rank, content, times)
    return made


def pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_name, capacity_tokens, key, piece_no, tokens``: a text is cut only if it exceeds the capacity."""
    # One row per packing; the list is part of the request and doesn't grow with the texts.
    listed = [F.struct(F.lit(r[0]).alias("spec_name"), F.lit(r[1]).alias("capacity_tokens")) for r in specs.select("spec_name", "capacity_tokens").filter("capacity_tokens > 0").collect()]
    none = F.array().cast("array<struct<spec_name:string,capacity_tokens:int>>")
    both = sizes.withColumn("_spec", F.explode(F.array(*listed) if listed else none)).select("*", "_spec.*").drop("_spec")
    count = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1)).cast("int")
    each = both.withColumn("piece_no", F.explode(F.sequence(F.lit(1), count)))
    return each.withColumn("tokens", F.least(F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity_tokens"), F.col("capacity_tokens").cast("bigint")))


#: Items of one length that are numbered together.
RANKED = 50_000


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Assign every text of ``sizes (key, tokens)`` to containers of each row of ``specs (spec_name, capacity_tokens)``.

    Returns ``spec_name, key, piece_no, tokens, container_id``. Containers are
    numbered from 0 in each spec. A text of no tokens has one piece and no
    container. Equal keys are packed as separate texts.
    """
    spark = sizes.sparkSession
    cuts = pieces(sizes, specs)
    # Two-level ranks: a length that a third of all texts share is numbered in as many parts as it needs.
    lengths = cut(cuts.groupBy("spec_name", "tokens").agg(F.ceil(F.count(F.lit(1)) / RANKED).cast("int").alias("parts")), "parts")
    # At most as many rows as the capacities have tokens.
    sized = cuts.join(F.broadcast(lengths), ["spec_name", "tokens"])
    salted = sized.withColumn("part", F.pmod(F.xxhash64("key", "piece_no"), F.col("parts")).cast("int")).drop("parts")
    counts = cut(salted.filter("tokens > 0").groupBy("spec_name", "capacity_tokens", "tokens", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("spec_name", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec_name", "tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    # At most capacity rows for each spec.
    for r in counts.groupBy("spec_name", "capacity_tokens", "tokens").agg(F.sum("n").alias("n")).collect():
        histograms.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    slots = [(name, *slot) for (name, capacity), h in sorted(histograms.items()) for slot in plan(h, capacity).slots]
    table = cut(spark.createDataFrame(slots, "spec_name string, tokens bigint, lo bigint, hi bigint, base bigint, per bigint"), "slots")
    # Numbers of the parts of one length are disjoint ranges, so a part starts at its offset.
    numbered = salted.join(offsets, ["spec_name", "tokens", "part"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("spec_name", "tokens", "part").orderBy("key", "piece_no")) - 1 + F.col("offset"))
    s, n = small(table, 200_000).alias("s"), numbered.alias("n")
    match = (F.col("s.spec_name") == F.col("n.spec_name")) & (F.col("s.tokens") == F.col("n.tokens")) & (F.col("n.rank") >= F.col("s.lo")) & (F.col("n.rank") < F.col("s.hi"))
    container = F.col("s.base") + F.floor((F.col("n.rank") - F.col("s.lo")) / F.col("s.per"))
    return n.join(s, match, "left").select("n.spec_name", "n.key", "n.piece_no", "n.tokens", container.cast("bigint").alias("container_id"))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the fewest containers any packing needs, and the share of room used."""
    used = packed.filter("container_id is not null").groupBy("spec_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(specs), "spec_name").select(
        "spec_name", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used"),
    )
