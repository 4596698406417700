"""Groups of texts with small edits, by DartMinHash signatures (problem 6).

Every set element owns a region of the plane (weight x rank). Hashed darts fall
into the plane, the same ones in every document; a document keeps, for each of
``k`` coordinates, the earliest dart in the regions of its own elements. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity, and a signature costs O(k log k) darts however large the set is.
Bands of coordinates join candidates, a one-bit sketch of the signature thins
them out, and an exact comparison of the texts decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut, small

_U64 = np.uint64
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))
_WORDS = re.compile("[a-z0-9]+")
_NOT_WORDS = re.compile("[^a-z0-9]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    with np.errstate(over="ignore"):
        x = (x + _U64(0x9E3779B97F4A7C15)).astype(_U64)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


#: Hashes of the first ranks and of the darts within a cell, and the number of darts by the first 16 bits of a cell's hash.
_RANKS, _DARTS = mix(np.arange(1 << 16, dtype=_U64)), mix(np.arange(1 << 20, (1 << 20) + 16, dtype=_U64))
_COUNTS = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) * 2.0**-16)


def _spread(x: np.ndarray) -> np.ndarray:
    """A cheap 64-bit finaliser, in place."""
    x ^= x >> _U64(32)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(29)
    return x


_PLACE = np.arange(1 << 14)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signatures of several weighted sets.

    ``elements`` holds the hashed elements of all sets one after another,
    ``weights`` their positive weights, ``starts`` the bounds of the sets
    (length sets + 1). Returns a ``sets x k`` array of dart hashes. The plane is
    cut into cells of one weight strip and one rank interval; each holds a
    Poisson(1) number of darts, and a dart counts if it falls below the weight.
    An empty set has the signature of zeros.
    """
    sets = len(starts) - 1
    empty = _U64(np.iinfo(_U64).max)
    best = np.full((sets, k), empty, dtype=_U64)
    plain = bool(np.all(weights == 1.0))
    need = k * np.log(max(k, 2)) + 1.5 * k
    for i in range(sets):
        own, mine, heights = best[i], elements[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]]
        room = None
        if not plain:
            # One strip for each begun unit of weight.
            strips = np.ceil(heights).astype(np.int64)
            which = np.repeat(np.arange(len(mine)), strips)
            strip = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
            room = np.minimum(heights[which] - strip, 1.0)
            mine = np.where(strip == 0, mine[which], mix(mine[which] ^ mix(strip.astype(_U64))))
        low, high = 0, int(np.ceil(need / max(heights.sum(), 1e-9))) if len(mine) else 0
        while len(mine):
            # Rank intervals follow each other until every coordinate has a dart.
            names = _RANKS[low:high] if high <= len(_RANKS) else mix(np.arange(low, high, dtype=_U64))
            cell = _spread((mine[None, :] + names[:, None]).ravel())
            count = _COUNTS.take((cell >> _U64(48)).view(np.int64))
            rows = np.repeat(_PLACE[: len(cell)] if len(cell) <= len(_PLACE) else np.arange(len(cell)), count)
            # Darts of a cell are numbered from 0.
            number = np.arange(len(rows))
            number -= (np.cumsum(count) - count).take(rows)
            dart = _spread(cell.take(rows) + _DARTS.take(number))
            if room is not None:
                inside = (mix(dart) >> _U64(11)).astype(np.float64) * 2.0**-53 < room[rows % len(mine)]
                dart, rows = dart[inside], rows[inside]
            where = ((dart >> _U64(42)) * _U64(k)) >> _U64(22)
            # The smallest of rank and dart is the earliest.
            dart &= _U64((1 << 42) - 1)
            dart |= ((rows // len(mine) + low) << 42).view(_U64)
            np.minimum.at(own, where.view(np.int64), dart)
            if not (own == empty).any():
                break
            low, high = high, high + (high - low + 1) // 2
    best[best == empty] = 0
    return mix(best)


_PLACES = mix(np.arange(1, 65, dtype=_U64)) | _U64(1)


class _Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def title_of(text: str) -> str:
    return _NOT_WORDS.sub(" ", text.lower()).strip()


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse, as many as the longest text has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1 << 14, 2 * n)
            self.up, self.down = (np.concatenate([np.ones(1, _U64), np.full(size, x, _U64)]).cumprod(dtype=_U64) for x in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, as :func:`words_of` has them."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(raw))
    # Sums of bytes times powers; a word's own sum is brought to the power zero.
    total = np.zeros(len(raw) + 1, _U64)
    np.cumsum((raw.astype(_U64) + _U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def _word_grams(texts: list[str], n: int, least: int, known: _Hashes) -> list[np.ndarray]:
    out = []
    for text in texts:
        h = word_hashes(text)
        if len(h) < max(least, n):
            out.append(np.empty(0, _U64))
            continue
        # Each place has an odd factor of its own, so that the order of the words counts.
        gram = h[: len(h) - n + 1] * _PLACES[0]
        for i in range(1, n):
            gram += h[i : len(h) - n + 1 + i] * _PLACES[i]
        out.append(np.unique(gram))
    return out


def _char_grams(texts: list[str], n: int, least: int, known: _Hashes) -> list[np.ndarray]:
    out = []
    for text in texts:
        title = title_of(text)
        if len(title) < least:
            out.append(np.empty(0, _U64))
            continue
        raw = np.frombuffer(title.encode("ascii"), np.uint8).astype(_U64)
        gram = np.zeros(len(raw) - n + 1, _U64)
        for i in range(n):
            gram = (gram << _U64(8)) | raw[i : len(raw) - n + 1 + i]
        out.append(np.unique(gram))
    return out


def _word_set(text: str, n: int) -> frozenset:
    words = words_of(text)
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False))


def _char_set(text: str, n: int) -> frozenset:
    title = title_of(text)
    return frozenset(title[i : i + n] for i in range(len(title) - n + 1))


@dataclass(frozen=True)
class Likeness:
    """What similarity means, and the bands that find it.

    ``bands`` bands of ``rows`` coordinates miss a pair of similarity ``s`` with
    probability ``(1 - s**rows)**bands``.
    """

    grams: Callable
    exact: Callable
    n: int
    least: int
    similarity: float
    bands: int
    rows: int
    hot: int = 2000

    @property
    def sketch_bits(self) -> int:
        return min(256, self.bands * self.rows)

    @property
    def sketch_least(self) -> float:
        """Agreeing bits of the sketch below which a pair is dropped: the expectation less five deviations."""
        p = (1 + self.similarity) / 2
        return self.sketch_bits * p - 5 * (self.sketch_bits * p * (1 - p)) ** 0.5


#: Bodies: sets of three-word sequences, at least 60 words. 0.6 is missed once in 700, 0.65 once in 20,000.
BODIES = Likeness(_word_grams, _word_set, 3, 60, 0.6, 80, 5)
#: Titles: sets of three-character substrings, at least 20 characters. 0.8 is missed once in 1,000.
TITLES = Likeness(_char_grams, _char_set, 3, 20, 0.8, 60, 10)


def _sign(kind: Likeness) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        k = kind.bands * kind.rows
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                grams = kind.grams(part["text"].tolist(), kind.n, kind.least, known)
                use = [i for i, g in enumerate(grams) if len(g)]
                if not use:
                    continue
                grams = [grams[i] for i in use]
                flat = np.concatenate(grams)
                sizes = np.array([len(g) for g in grams])
                signature = dart_signatures(flat, np.ones(len(flat)), np.concatenate([[0], np.cumsum(sizes)]), k)
                folded = np.zeros((len(use), kind.bands), _U64)
                for r in range(kind.rows):
                    folded = mix(folded) + signature[:, r * kind.bands : (r + 1) * kind.bands]
                folded = mix(folded + np.arange(kind.bands, dtype=_U64))
                bits = np.packbits((signature[:, : kind.sketch_bits] & _U64(1)).astype(np.uint8), axis=1)
                # The whole set in 128 bits: texts with equal sets are copies.
                begin = np.cumsum(sizes) - sizes
                one = np.add.reduceat(mix(flat), begin)
                two = np.add.reduceat(mix(flat ^ _U64(0xA5A5A5A5A5A5A5A5)), begin)
                yield pd.DataFrame({
                    "key": part["key"].to_numpy()[use], "t": part["t"].to_numpy()[use], "h1": one.view(np.int64), "h2": two.view(np.int64),
                    "bands": list(folded.view(np.int64)), "sketch": [b.tobytes() for b in bits],
                })

    return run


def signatures(df: DataFrame, key: str, text: str, kind: Likeness) -> DataFrame:
    """``key, t, h1, h2, bands, sketch`` of every row whose text is long enough; ``t`` is a hash of the text as it is."""
    texts = df.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return texts.mapInPandas(_sign(kind), "key bigint, t bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch binary")


def _agreeing(kind: Likeness):
    """Bits that two sketches share."""
    def eight(name: str, i: int):
        return F.conv(F.hex(F.substring(name, 8 * i + 1, 8)), 16, -10).cast("bigint")

    words = (kind.sketch_bits + 63) // 64
    return kind.sketch_bits - sum((F.bit_count(eight("sa", i).bitwiseXOR(eight("sb", i))) for i in range(words)), F.lit(0))


def _pairs_of_hot(members: DataFrame, texts: DataFrame, kind: Likeness) -> DataFrame:
    """Candidates among the members of overfull buckets, by prefix filtering: exact, and no bucket is expanded.

    Elements are ordered by rarity. Two sets of the similarity ``s`` share one
    of the first ``size - ceil(s * size) + 1`` elements of each, so joining
    these prefixes loses no pair.
    """
    s = kind.similarity

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [kind.grams([text], kind.n, kind.least, known)[0].view(np.int64) for text in part["text"]]
                sizes = np.array([len(g) for g in found])
                yield pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), sizes), "gram": np.concatenate(found), "size": np.repeat(sizes, sizes)})

    grams = cut(texts.join(members.distinct(), "key", "left_semi").mapInPandas(elements, "key bigint, gram bigint, size int"), "hot")
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(df.filter("df > 1"), "gram").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("df", "gram")) + F.col("size"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("key"))
    # Elements of one set alone come first in the order and meet nothing.
    ranked = ranked.withColumn("rank", F.col("rank") - shared)
    prefix = ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * s - 1e-9) + 1).select("key", "gram", "size")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.size") * s <= F.col("b.size") + 1e-9) & (F.col("b.size") * s <= F.col("a.size") + 1e-9)
    return a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.key") < F.col("b.key")) & near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def candidates(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], kind: Likeness) -> DataFrame:
    """Distinct pairs ``a < b`` of representatives that share a band and whose sketches agree enough."""
    banded = reps.select("key", F.explode("bands").alias("h"))
    # Most buckets hold one text and go here; of two, the aggregate knows both.
    buckets = cut(banded.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).filter("n > 1"), "buckets")
    pairs = buckets.filter("n = 2 and a < b").select("a", "b")
    some = buckets.filter(F.col("n").between(3, kind.hot)).select("h")
    shared = cut(banded.join(small(some, 1_000_000), "h", "left_semi"), "shared-buckets")
    x, y = (shared.select("h", F.col("key").alias(k)) for k in ("a", "b"))
    pairs = pairs.unionByName(x.join(y, "h").filter("a < b").select("a", "b")).distinct()
    # How an overfull bucket is treated changes the work and not the pairs.
    full = cut(buckets.filter(F.col("n") > kind.hot).select("h"), "full")
    if not full.isEmpty():
        hot = banded.join(small(full, 1_000_000), "h", "left_semi").select("key")
        pairs = pairs.unionByName(_pairs_of_hot(hot, texts_of(hot), kind)).distinct()
    sketches = reps.select("key", "sketch")
    pairs = pairs.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
    return pairs.filter(_agreeing(kind) >= kind.sketch_least).select("a", "b").distinct()


def _compare(kind: Likeness) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, sets = [], {}
            for x, y in zip(batch["ta"], batch["tb"], strict=True):
                p, q = (sets.get(t) or sets.setdefault(t, kind.exact(t, kind.n)) for t in (x, y))
                both = len(p & q)
                found.append(both / max(len(p) + len(q) - both, 1))
            out = batch.drop(columns=["ta", "tb"]).assign(similarity=found)
            yield out[out["similarity"] >= kind.similarity]

    return run


def class_names(classes: DataFrame, rep: str, h: str) -> tuple[DataFrame, DataFrame]:
    """``(classes, shared)``: a number ``cid`` for each class, and the representatives of several classes.

    A class goes by its representative's key, which is small and compresses
    well. Where a key stands for several classes, because it occurs with several
    texts, they go by the hash ``h``, below zero.
    """
    shared = cut(classes.groupBy(F.col(rep).alias("_rep")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_rep"), "shared")
    return named(classes, shared, rep, h), shared


def named(df: DataFrame, shared: DataFrame, rep: str, h: str) -> DataFrame:
    """Adds ``cid`` of the class that has the representative ``rep`` and the hash ``h``."""
    with_shared = df.join(small(shared, 1_000_000), F.col(rep) == F.col("_rep"), "left")
    return with_shared.withColumn("cid", F.when(F.col("_rep").isNull(), F.col(rep)).otherwise(-1 - F.pmod(F.col(h), F.lit(1 << 62)))).drop("_rep")


def linked_representatives(df: DataFrame, key: str, text: str, kind: Likeness) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    ``members (key, t, cid, rep)`` has every row whose text is long enough, with
    a hash ``t`` of the text; ``cid`` is its class, of equal sets of elements,
    and ``rep`` the smallest key of the class. ``links (a, b, similarity)`` has
    every pair of classes ``a < b`` of at least the required similarity. Rows
    with a null key, a null text or one that is too short are in neither. A key
    may occur with several texts; each is a row of its own. Other columns are
    ignored.
    """
    signed = cut(signatures(df, key, text, kind), "signed")
    classes, shared = class_names(signed.groupBy("h1", "h2").agg(F.min("key").alias("rep")), "rep", "h1")
    members = cut(signed.select("key", "t", "h1", "h2").join(classes, ["h1", "h2"]).select("key", "t", "h1", "h2", "rep", "cid"), "members")
    # Copies are few, or many of few texts: leaving them out shuffles no signature while their keys fit a broadcast.
    copies = small(cut(members.filter("key <> rep").select("key", "h1", "h2"), "copies"), 1_000_000)
    reps = named(signed.join(copies, ["key", "h1", "h2"], "left_anti"), shared, "key", "h1").select(F.col("cid").alias("key"), "bands", "sketch")
    texts = df.select(F.col(key).cast("bigint").alias("row"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("row is not null and text is not null")
    pairs = cut(candidates(reps, lambda some: _texts_of(texts, members, some), kind), "pairs")
    picked = _texts_of(texts, members, pairs.select(F.explode(F.array("a", "b")).alias("key")))
    joined = pairs.join(picked.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(picked.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    links = joined.select("a", "b", "ta", "tb").mapInPandas(_compare(kind), "a bigint, b bigint, similarity double")
    return members.drop("h1", "h2"), cut(links, "links")


def _texts_of(texts: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, text`` of one row of each class in ``wanted (key)``."""
    firsts = members.filter("key = rep").groupBy("cid", "rep").agg(F.min("t").alias("t")).select(F.col("cid").alias("key"), F.col("rep").alias("row"), "t")
    rows = cut(firsts.join(wanted.distinct(), "key", "left_semi"), "rows")
    # A row that is written twice gives its text twice.
    return texts.join(small(rows, 1_000_000), ["row", "t"]).select("key", "text").dropDuplicates(["key"])


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of rows ``id_a < id_b``, copies included, from classes and links between them."""
    both = links.select("a", "b").unionByName(members.select(F.col("cid").alias("a"), F.col("cid").alias("b")).distinct())
    left = both.join(members.select(F.col("cid").alias("a"), F.col("key").alias("x")), "a")
    pairs = left.join(members.select(F.col("cid").alias("b"), F.col("key").alias("y")), "b").filter("a <> b or x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, rep, links``: each row's class of copies and the number of other classes it is linked to."""
    counts = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    return members.join(counts, "cid", "left").select("key", "rep", F.coalesce("links", F.lit(0)).alias("links"))
