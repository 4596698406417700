"""Evaluation records that appear in the training split, exactly or almost (problem 2).

Passages, normalised to words, go into Aho-Corasick automata. The automata are
sharded by a bound on their passages, and all texts of the other side are
scanned: blocks of texts, or of the pieces of them that a shard may match,
travel with the passages of the shard through a shuffle. Passages are the
three-word sequences that similarity is defined on, and of each text only its
rarest ones: of a pair of similarity ``s``, the one with fewer sequences shares
``m = ceil(2 s n / (1 + s))`` of its ``n`` at least, hence at least ``c`` of any
``n - m + c``. Those that no text of the other side holds are known to be
missing, so few others have to be looked for. As either one may be the smaller,
training texts are scanned for passages of evaluation records, and evaluation
records for those of training texts. Pairs with fewer matches than that can't
be similar; the others are compared exactly.
Matched intervals are merged into the coverage of each evaluation record.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import site_of
from tidewire.llm.near_duplicates import _PLACES, _Hashes, class_names, named, words_of
from tidewire.runtime import cut, small

#: Passages of one automaton, counted for each record; about 150 MB.
SHARD = 250_000
#: Characters of text whose passages are counted in one part.
PART = 32_000_000
#: Characters of training text scanned with one copy of an automaton.
BLOCK = 48_000_000
#: Matches that a pair must have beyond the first.
EXTRA = 8
N = 3


def passages_of(text: str) -> list[str]:
    """Three-word sequences in order, blanks at both ends."""
    words = words_of(text)
    return [f" {' '.join(words[i : i + N])} " for i in range(len(words) - N + 1)]


def _hashed(words: list[str], known: _Hashes) -> np.ndarray:
    """64-bit hashes of the three-word sequences at each position."""
    if len(words) < N:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - N + 1] * _PLACES[0]
    for i in range(1, N):
        out += h[i : len(h) - N + 1 + i] * _PLACES[i]
    return out.view(np.int64)


def _asked(parts: int):
    """Some texts of one side at a time: the texts, and for each part of the hashes theirs, with how many of the texts hold each.

    ``ask`` names the texts by all their keys; should a repeated task meet them
    in another order, its answers don't fit and :func:`_chosen` says so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            for (flag, _), some in batch.groupby(["is_train", np.arange(len(batch)) // 2000], sort=False):
                ask = xxhash.xxh64_intdigest(some["key"].to_numpy(np.int64).tobytes() + bytes([bool(flag)])) >> 1
                h, n = np.unique(np.concatenate([np.unique(_hashed(words_of(t), known)) for t in some["text"]]), return_counts=True)
                order = np.argsort(h % parts, kind="stable")
                ends = np.searchsorted((h % parts)[order], np.arange(parts + 1))
                h, n = h[order], n[order].astype(np.int32)
                # Without nulls, a key never becomes a float.
                rows = [(ask, p, flag, 0, None, h[a:b].tobytes(), n[a:b].tobytes()) for p, (a, b) in enumerate(pairwise(ends.tolist()))]
                rows += [(ask, ask % parts, flag, k, t, None, None) for k, t in zip(some["key"], some["text"], strict=True)]
                yield pd.DataFrame(rows, columns=["ask", "part", "is_train", "key", "text", "h", "n"])

    return run


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """For the hashes of one part: how many texts of the other side hold each; texts pass."""
    asks = group[group["h"].notna()]
    counts = {}
    for flag, own in asks.groupby("is_train"):
        h, n = np.frombuffer(b"".join(own["h"]), np.int64), np.frombuffer(b"".join(own["n"]), np.int32)
        names, at = np.unique(h, return_inverse=True)
        counts[flag] = names, np.bincount(at, weights=n, minlength=len(names)).astype(np.int32)
    out = []
    for flag, h in zip(asks["is_train"], asks["h"], strict=True):
        own, df = np.frombuffer(h, np.int64), np.zeros(len(h) // 8, np.int32)
        names, n = counts.get(not flag, (np.empty(0, np.int64), np.empty(0, np.int32)))
        if len(names):
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            df = np.where(names[at] == own, n[at], 0).astype(np.int32)
        out.append(df.tobytes())
    texts = group[group["h"].isna()]
    return pd.concat([asks.assign(n=out), texts])[["ask", "part", "is_train", "key", "text", "n"]]


def _chosen(similarity: float, parts: int):
    """The rarest passages of the texts of one ask, from the answers of all parts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known, rows, texts = _Hashes(), [], group[group["text"].notna()]
        answers = group[group["n"].notna()].sort_values("part")["n"]
        each, tokens = [], []
        for text in texts["text"]:
            tokens.append(words_of(text))
            each.append(np.unique(_hashed(tokens[-1], known), return_index=True))
        names = np.unique(np.concatenate([h for h, _ in each])) if each else np.empty(0, np.int64)
        df = np.frombuffer(b"".join(answers), np.int32)
        if len(answers) != parts or len(df) != len(names):
            raise RuntimeError("the texts of a repeated task came in another order; run the query again")
        order = np.argsort(names % parts, kind="stable")
        count = np.empty(len(names), np.int32)
        count[order] = df
        share = 2 * similarity / (1 + similarity)
        for key, flag, words, (h, at) in zip(texts["key"], texts["is_train"], tokens, each, strict=True):
            n = count[np.searchsorted(names, h)]
            rare = np.lexsort((h, n))[int((n == 0).sum()) :]
            # Hashes may collide, so that these are the passages that texts of the other side may hold.
            missing = len(h) - math.ceil(len(h) * share - 1e-9) - (len(h) - len(rare))
            if missing < 0 or not len(rare):
                continue
            take = min(missing + EXTRA, len(rare))
            rows += [(flag, key, take - missing, int(h[i]), f" {' '.join(words[at[i] : at[i] + N])} ") for i in rare[:take]]
        return pd.DataFrame(rows, columns=["is_train", "key", "least", "h", "passage"])

    return run


def rare_passages(texts: DataFrame, similarity: float) -> DataFrame:
    """``is_train, key, least, h, passage``: the rarest passages of each text ``(key, is_train, text)`` that texts of the other side hold.

    The smaller one of a similar pair has ``2 s / (1 + s)`` of its sequences in
    the other. A text that has fewer than that in all of the other side is no
    pair's smaller one, and has no rows.
    """
    parts = max(1, math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / PART))
    asked = texts.select("key", "is_train", "text").mapInPandas(_asked(parts), "ask bigint, part int, is_train boolean, key bigint, text string, h binary, n binary")
    answered = asked.groupBy("part").applyInPandas(_answered, "ask bigint, part int, is_train boolean, key bigint, text string, n binary")
    return answered.groupBy("ask").applyInPandas(_chosen(similarity, parts), "is_train boolean, key bigint, least int, h bigint, passage string")


def _route(shards: int):
    """Pieces of texts for each shard: the passages whose hashes are the shard's, neighbours joined, one row for many texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            for (flag, _), some in batch.groupby(["is_train", np.arange(len(batch)) // 2000], sort=False):
                rows: dict[int, tuple[list[int], list[str]]] = {}
                for key, text in zip(some["key"], some["text"], strict=True):
                    words, pieces = words_of(text), {}
                    for i, shard in enumerate((_hashed(words, known) % shards).tolist()):
                        own = pieces.setdefault(shard, [])
                        if own and i <= own[-1][1]:
                            own[-1][1] = i + N
                        else:
                            own.append([i, i + N])
                    for shard, own in pieces.items():
                        keys, parts = rows.setdefault(shard, ([], []))
                        keys.append(key)
                        parts.append("|".join([f" {' '.join(words[a:b])} " for a, b in own]))
                yield pd.DataFrame([(flag, shard, keys, "\n".join(parts)) for shard, (keys, parts) in rows.items()], columns=["is_train", "shard", "keys", "text"])

    return run


def _scan(shards: int):
    """Reads the passages of a shard, then a block of texts or pieces, which it scans with the shard's automaton.

    A text that holds ``least`` passages of another holds its share of them in
    at least one shard; fewer matches than that never leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _scanned(batches, shards)

    return run


def _scanned(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    place, machine, owners, share = None, None, [], {}
    for batch in batches:
        sides, holders, records, counts, needed = [], [], [], [], []
        for side, shard, block, turn, keys, text, least in zip(*(batch[c].tolist() for c in ("is_train", "shard", "block", "turn", "keys", "text", "least")), strict=True):
            if (side, shard, block) != place:
                place, machine, owners, share, ready = (side, shard, block), ahocorasick.Automaton(ahocorasick.STORE_INTS), [], {}, False
            if turn == 0:
                key = int(keys[0])
                share[key] = (-(-least // shards), least)
                if (at := machine.get(text, -1)) < 0:
                    machine.add_word(text, len(owners))
                    owners.append([key])
                else:
                    owners[at].append(key)
                continue
            if not ready:
                machine.make_automaton()
                ready = True
            if not owners:
                continue
            for key, own in zip(keys, text.split("\n") if turn == 2 else [f" {' '.join(words_of(text))} "], strict=True):
                hits = {i for _, i in machine.iter(own)}
                for record, n in Counter(chain.from_iterable(map(owners.__getitem__, hits))).items() if hits else ():
                    enough, all_of = share[record]
                    if n >= enough:
                        sides.append(side), holders.append(key), records.append(record), counts.append(n), needed.append(all_of)
        if records:
            yield pd.DataFrame({"is_train": sides, "holder": holders, "key": records, "n": counts, "least": needed})


def matches(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``train, key``: which training and evaluation texts ``(key, is_train, text)`` may hold ``least`` of each other's passages ``(is_train, key, least, h, passage)``.

    Passages are sharded by their hash. Where there are several shards, a
    shard receives the pieces of texts that are passages of its hashes: each
    position of a text goes to one shard, so that the work grows with the texts
    and not with their product with the shards, and a frequent word is in many
    shards. No pair is missing; where a text needs more passages than there are
    shards, some pairs too many come out.
    """
    most = {r[0]: r[1] for r in passages.groupBy("is_train").count().collect()}
    shards = max(1, math.ceil(max(most.values(), default=0) / SHARD))
    sizes = {r[0]: r[1] or 0 for r in texts.groupBy("is_train").agg(F.sum(F.length("text"))).collect()}
    blocks = max(1, math.ceil(max(sizes.values(), default=0) * (1 if shards == 1 else N) / shards / BLOCK))
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    # A side is that of the texts to scan, so the passages are the other side's.
    first = passages.select((~F.col("is_train")).alias("is_train"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("turn"), F.array("key").alias("keys"), F.col("passage").alias("text"), "least")
    if shards == 1:
        then = texts.select("is_train", F.lit(0).alias("shard"), block("key"), F.lit(1).alias("turn"), F.array("key").alias("keys"), "text", F.lit(0).alias("least"))
    else:
        then = texts.select("key", "is_train", "text").mapInPandas(_route(shards), "is_train boolean, shard int, keys array<bigint>, text string").select("is_train", "shard", block(F.col("keys")[0]), F.lit(2).alias("turn"), "keys", "text", F.lit(0).alias("least"))
    found = first.unionByName(then).repartition("is_train", "shard", "block").sortWithinPartitions("is_train", "shard", "block", "turn").mapInPandas(_scan(shards), "is_train boolean, holder bigint, key bigint, n int, least int")
    # A shard that kept a pair to itself has less than its share of matches.
    all_of = F.sum("n") + (shards - F.count(F.lit(1))) * (F.ceil(F.max("least") / shards) - 1)
    enough = found.groupBy("is_train", "holder", "key").agg(all_of.alias("most"), F.max("least").alias("least")).filter("most >= least")
    return enough.select(F.when(F.col("is_train"), F.col("holder")).otherwise(F.col("key")).alias("train"), F.when(F.col("is_train"), F.col("key")).otherwise(F.col("holder")).alias("key")).distinct()


def _compare(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for train, key, x, y in zip(batch["train"], batch["key"], batch["tx"], batch["ty"], strict=True):
                a, order = set(passages_of(x)), passages_of(y)
                b = set(order)
                both = len(a & b)
                alike = both / max(len(a) + len(b) - both, 1)
                if alike >= similarity:
                    intervals: list[list[int]] = []
                    for at, p in enumerate(order):
                        if p in a:
                            if intervals and at <= intervals[-1][1]:
                                intervals[-1][1] = at + N
                            else:
                                intervals.append([at, at + N])
                    rows.append((train, key, alike, intervals))
            yield pd.DataFrame(rows, columns=["train", "key", "similarity", "intervals"])

    return run


def overlaps(df: DataFrame, key: str = "aligned_id", text: str = "body_clean", split: str = "split", train: str = "train", similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)`` of cross-split overlaps.

    ``classes (key, split, is_train, cid)`` has every row with the class of its
    text on its side. ``links (train, key, similarity, intervals)`` has every
    pair of a training and an evaluation class of at least ``similarity``, with
    the merged word intervals of the evaluation text that match. Rows with a
    null key, text or split, and texts of fewer than three words, overlap with
    nothing. A key may occur with several texts; each is a row of its own.
    Other columns are ignored.
    """
    named_rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(split).alias("split")).filter("id is not null and text is not null and split is not null")
    rows = named_rows.withColumn("is_train", F.col("split") == train).withColumn("t1", F.xxhash64("text"))
    keyed = cut(rows.select(F.col("id").alias("key"), "split", "is_train", "t1", F.hash(F.lit(1), "text").alias("t2")), "keyed")
    # A training and an evaluation class may share a number; nothing confuses the sides.
    firsts, shared = class_names(keyed.groupBy("t1", "t2", "is_train").agg(F.min("key").alias("rep")), "rep", "t1")
    classes = cut(keyed.join(firsts, ["t1", "t2", "is_train"]).select("key", "split", "is_train", "t1", "rep", "cid"), "classes")
    # One row of each text; no text is shuffled while the rows of the copies fit a broadcast.
    copies = small(cut(classes.filter("key <> rep").select(F.col("key").alias("id"), "t1", "is_train").distinct(), "copies"), 1_000_000)
    only = named(rows.join(copies, ["id", "t1", "is_train"], "left_anti"), shared, "id", "t1").select(F.col("cid").alias("key"), "is_train", "text")
    passages = cut(rare_passages(only, similarity), "passages")
    pairs = cut(matches(only, passages), "overlap")
    wanted = cut(pairs.select(F.explode(F.array("train", "key")).alias("key")).distinct(), "wanted")
    texts = only.join(small(wanted, 1_000_000), "key", "left_semi").dropDuplicates(["key", "is_train"])
    joined = pairs.join(texts.filter("is_train").select(F.col("key").alias("train"), F.col("text").alias("tx")), "train").join(texts.filter("not is_train").select("key", F.col("text").alias("ty")), "key")
    links = joined.select("train", "key", "tx", "ty").mapInPandas(_compare(similarity), "train bigint, key bigint, similarity double, intervals array<array<int>>")
    return classes.select("key", "split", "is_train", "cid"), cut(links, "links")


def pairs_of_rows(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b`` of every overlapping pair of rows, smaller key first."""
    of = lambda flag, cid, name: classes.filter(F.col("is_train") == flag).select(F.col("cid").alias(cid), F.col("key").alias(name))
    both = links.select("train", F.col("key").alias("record")).join(of(True, "train", "x"), "train").join(of(False, "record", "y"), "record")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def covered_words(links: DataFrame) -> DataFrame:
    """``key, covered``: words of each evaluation class within the union of its matched intervals."""
    # Distinct intervals are bounded by the record's own length, however many training texts match.
    spans = links.select("key", F.explode("intervals").alias("i")).select("key", F.col("i")[0].alias("s"), F.col("i")[1].alias("e")).distinct()
    before = Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(before), F.lit(0))
    return spans.withColumn("new", F.greatest(F.col("e") - F.greatest("s", reach), F.lit(0))).groupBy("key").agg(F.sum("new").cast("bigint").alias("covered"))


def report(df: DataFrame, classes: DataFrame, links: DataFrame, key: str = "aligned_id", url: str = "url") -> DataFrame:
    """Per evaluation split and site: overlapping rows, pairs and words covered; a key with several urls counts for its first site."""
    sites = df.select(F.col(key).cast("bigint").alias("key"), site_of(F.col(url)).alias("site")).filter("key is not null").groupBy("key").agg(F.min("site").alias("site"))
    copies = classes.filter("is_train").groupBy(F.col("cid").alias("train")).agg(F.count(F.lit(1)).alias("copies"))
    per = links.join(copies, "train").groupBy("key").agg(F.sum("copies").alias("pairs")).join(covered_words(links), "key")
    rows = classes.filter("not is_train").join(sites, "key", "left").join(per.withColumnRenamed("key", "cid"), "cid")
    return rows.groupBy("split", "site").agg(F.count(F.lit(1)).alias("rows"), F.sum("pairs").alias("pairs"), F.sum("covered").alias("covered_words"))
