"""Joins and duplicate removal that keep the first row in a stated order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; rows with a null in a key are all kept.

    ``order`` should end with a unique column. Rows with a null key take no part
    in the shuffle, so that however many they are they meet in no task; of the
    others each task passes on the first row of a key only.
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    first = Window.partitionBy(*keys).orderBy(*order)
    kept = df.filter(complete).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return kept.unionByName(df.filter(~complete))


def keep_first_in_turn(df: DataFrame, keys: list[list[str]], order: list[Column | str]) -> DataFrame:
    """:func:`keep_first` by one key after another; each pass sees the survivors of the last."""
    for k in keys:
        df = keep_first(df, k, order)
    return df


def not_yet_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``done``; used to resume a load."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def fill_from(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``other`` where not null, else the row's own."""
    renamed = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def onto_spine(spine: DataFrame, df: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Every row of the spine once, with ``fill`` where ``df`` has none."""
    return spine.join(df, on, "left").fillna(fill)


def compare(base: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Two results side by side as ``<column>_base`` and ``<column>_cand``."""
    a = base.select(*on, *[F.col(c).alias(f"{c}_base") for c in columns])
    return a.join(other.select(*on, *[F.col(c).alias(f"{c}_cand") for c in columns]), on)


def without_similar(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows that resemble no earlier row; an earlier row counts even if it goes itself. ``pairs (a, b)`` has the earlier one first."""
    return df.join(pairs.select(F.col("b").alias(key)).distinct(), key, "left_anti")


def repaired(df: DataFrame, other: DataFrame, on: list[str], suffix: str = "_lex") -> DataFrame:
    """Left join in which columns that both sides have fill the nulls of the left one; the right one's other columns are added."""
    both = [c for c in other.columns if c in df.columns and c not in on]
    joined = df.join(other.select(*[F.col(c).alias(f"{c}{suffix}") if c in both else F.col(c) for c in other.columns]), on, "left")
    for c in both:
        joined = joined.withColumn(c, F.coalesce(c, f"{c}{suffix}")).drop(f"{c}{suffix}")
    return joined


def numbered_features(df: DataFrame, features: DataFrame, on: str, prefix: str = "emb_", skip: tuple[str, ...] = ("news_date", "split")) -> DataFrame:
    """Left join of a table of features, its columns renamed in order to ``prefix`` and a number, 0 where there are none."""
    names = [c for c in features.columns if c != on and c not in skip]
    renamed = features.select(on, *[F.col(f"`{c}`").cast("double").alias(f"{prefix}{i}") for i, c in enumerate(names, 1)])
    return df.join(renamed, on, "left").fillna(0.0, [f"{prefix}{i}" for i in range(1, len(names) + 1)])


def tagged_union(tables: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    """Tables on top of each other with the name of each; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        named = df.withColumn(tag, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that depend on the key and the seed alone; a sampling operator."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)).limit(n)


def in_order(df: DataFrame, column: str, order: tuple[str, ...], *rest: Column | str) -> DataFrame:
    """Rows sorted by the place of a value in a list, unknown values last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), F.col(column), *rest)


#: Parts of a vector whose lengths bound a cosine, a byte each.
_PARTS = 128


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and the number of the list of each."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def _postings(threshold: float):
    """``t, mass, parts, id`` of each term of a vector's prefix: the squared length from it on, and the lengths of the vector's parts, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (t, of), w = batch.num_rows, _flat(batch["t"]), _flat(batch["w"])[0]
            square = w * w
            whole, before = np.bincount(of, square, n), np.cumsum(square) - square
            sizes = np.bincount(of, minlength=n)
            first = np.concatenate([before, [0.0]])[np.minimum(np.cumsum(sizes) - sizes, len(t))]
            mass = whole[of] - (before - first[of])
            lengths = np.sqrt(np.bincount(of * _PARTS + t % _PARTS, square, n * _PARTS)).reshape(n, _PARTS)
            parts = np.minimum(np.ceil(lengths * 255), 255).astype(np.uint8)
            at = np.flatnonzero(mass >= threshold * threshold - 1e-9)
            packed = pa.array([parts[i].tobytes() for i in range(n)], pa.binary()).take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(mass[at]), packed, batch["id"].take(pa.array(of[at]))], ["t", "mass", "parts", "id"])

    return run


def _meetings(threshold: float, most: int = 500_000):
    """``x, y`` of postings of one term, in order of ``t``, whose bounds allow a cosine of ``threshold``; ``most`` pairs are held at once."""

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        t, mass, ids = rows["t"].to_numpy(), rows["mass"].to_numpy(), rows["id"].combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        parts = np.frombuffer(b"".join(rows["parts"].to_pylist()), np.uint8).reshape(-1, _PARTS)
        begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.concatenate([begins, [len(t)]]))
        start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        # Of two whose masses have a product of the squared threshold, one has the threshold by itself.
        head = mass >= threshold - 1e-9
        heads = np.flatnonzero(head & (size > 1))
        block = np.cumsum(size[heads]) // most
        for own in np.split(heads, np.flatnonzero(np.diff(block)) + 1):
            n = size[own]
            a, b = np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[own], n)
            fit = (mass[a] * mass[b] >= threshold * threshold - 1e-9) & (~head[b] | (a < b)) & (a != b)
            a, b = a[fit], b[fit]
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                bound = np.einsum("ij,ij->i", parts[x].astype(np.float32), parts[y].astype(np.float32)) / (255 * 255)
                near = bound >= threshold - 1e-4
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[near])), ids.take(pa.array(y[near]))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch["t"].to_numpy()
            last = int(np.searchsorted(t, t[-1]))
            if held and held[0]["t"][0].as_py() == t[-1]:
                held.append(batch)
                continue
            if held or last:
                yield from met(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from met(pa.Table.from_batches(held))

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, cosine`` of pairs with both vectors."""
    for batch in batches:
        (ta, of_a), (tb, of_b), wa, wb = _flat(batch["ta"]), _flat(batch["tb"]), _flat(batch["wa"])[0], _flat(batch["wb"])[0]
        names, code = np.unique(np.concatenate([ta, tb]), return_inverse=True)
        a, b = of_a * len(names) + code[: len(ta)], of_b * len(names) + code[len(ta) :]
        at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
        same = a[at] == b if len(a) else np.zeros(0, bool)
        dot = np.bincount(of_b[same], wa[at[same]] * wb[same], batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(dot)], ["a", "b", "cosine"])


def candidates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs ``a < b`` of ``vectors (id, t, w)`` that can have a cosine of ``threshold``: all that have it and few others.

    ``t`` numbers the terms, ascending in each vector, the rarest first. Of each
    vector only the terms are joined whose leaving out would take it below the
    threshold; at the first term that two share, the product of the lengths from
    there on bounds the cosine, and so do the lengths of their parts.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    postings = vectors.mapInArrow(_postings(threshold), f"t bigint, mass double, parts binary, id {kind}")
    met = postings.repartition("t").sortWithinPartitions("t").mapInArrow(_meetings(threshold), f"x {kind}, y {kind}")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``a, b, cosine`` of all pairs ``a < b`` of unit ``vectors (id, t, w)``, numbered as for :func:`candidates`, whose cosine is at least ``threshold``."""
    kind = vectors.schema["id"].dataType.simpleString()
    pairs = cut(candidates(vectors, threshold), "candidates")
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = vectors.join(used, "id", "left_semi")
    a, b = (vectors.select(F.col("id").alias(x), F.col("t").alias(f"t{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    out = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "wa", "tb", "wb").mapInArrow(_cosines, f"a {kind}, b {kind}, cosine double")
    return out.filter(F.col("cosine") >= threshold)


def similar_earlier(weights: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs ``a < b`` of rows whose unit vectors ``weights (id, term, w)`` have a cosine of at least ``threshold``; exact by :func:`candidates`."""
    terms = cut(weights.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "term").select("term", F.monotonically_increasing_id().alias("t")), "terms")
    lists = weights.filter("id is not null").join(terms, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("v"))
    return similar_vectors(cut(lists.select("id", F.col("v.t").alias("t"), F.col("v.w").alias("w")), "vectors"), threshold)
