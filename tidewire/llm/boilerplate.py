"""The main body of each page, without navigation, notices, teasers and footers (problem 4).

Pages of one host are taken for fillings of one template, which is deduced from
the pages alone:

1. *Tokens.* Pairs of neighbouring words of a line, its two borders included,
   with numbers and the host's own name as slots, and every whole line. Prose
   (a sentence of nine words or more) only counts as a whole line.
2. *Classes.* Tokens of a host with the same occurrence vector form an
   equivalence class. The vector is known by the xor of its pages' hashes, so
   vectors are never gathered.
3. *Validity.* A class is valid if its tokens follow each other in one order
   and don't cross another class on at least nine tenths of its pages.
4. *Nesting.* The root of the template is the main slot, from a page's first
   line of prose to its last. A line belongs to the class of that border of it
   which occurs on more pages, its *frame*, and leaves what the frame leaves
   open as slots. Per frame it is counted how many lines lie outside the main
   slot, hold a class of their own in their slots (a constant, in changing
   surroundings), hold a headline of the host, or numbers alone.
5. *Slots.* Frames whose lines mostly show one of these marks are furniture;
   a host's share is drawn towards that of the same frame on all hosts. Whole
   lines on ten pages are furniture too. The rest is the content of the main
   slot.

No word list takes part. Work on a page needs the tokens of that page alone, so
pages travel with the tokens of a bounded part of their host.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import site_of
from tidewire.runtime import cut

#: Pages of a host on which a token of its template occurs, and those of a line that is furniture as a whole.
SUPPORT, WHOLE = 3, 10
#: Characters of a host's pages that are examined together.
PART = 6_000_000
#: Share of pages on which a class must keep its order and its nesting.
VALID = 0.9
#: Share of marked lines that makes a frame furniture, and lines that the share over all hosts weighs.
MARKED, PRIOR = 0.6, 10
#: Marks of a line.
CONSTANT, OUTSIDE, HEADLINE, NUMBERS = 1, 2, 4, 8

_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d[\d.,]*\d|\d|[^\w\s]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_END = re.compile(r"[.!?…。．！？][”\"’')]*$")


def clean(line: str) -> str:
    """A line without invisible characters and with single blanks."""
    return " ".join(_INVISIBLE.sub("", line).split())


def is_prose(line: str) -> bool:
    """A sentence of nine words or more."""
    return line.count(" ") >= 8 and _END.search(line) is not None


_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def token_hash(token: str) -> int:
    """A pair of words: the border signs ``^`` and ``$``, the slots ``#`` and ``@``, or words in lower case."""
    a, b = token.split(" ")
    return _signed((word_hash(a) * int(_FIRST) + word_hash(b) * int(_SECOND)) & _ALL)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: str) -> int:
    """The token of a whole line."""
    return _signed(xxhash.xxh64_intdigest(f"= {line.lower()}"))


_BEGIN, _STOP, _NUMBER, _NAME = map(word_hash, "^$#@")


class _Words(dict):
    """Hashes of a host's words, numbers and the host's own name as slots; remembered."""

    def __init__(self, site: str):
        super().__init__()
        self.site, name = site, site.split(".")[0]
        self.stem = name if len(name) >= 4 else ""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = word.lower()
        self[word] = value = _NUMBER if word[0].isdigit() else _NAME if self.stem and self.stem in k else word_hash(k)
        return value


class _Known(OrderedDict):
    """The words of the hosts seen last."""

    def __missing__(self, site: str) -> _Words:
        if len(self) > 200:
            self.popitem(last=False)
        self[site] = words = _Words(site)
        return words


def pairs_of(lines: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of lines one after another, the number of each token's line, and whether its second word is a number."""
    flat, sizes = [], []
    for line in lines:
        found = _WORD.findall(line)
        flat += [_BEGIN, *map(words.__getitem__, found), _STOP]
        sizes.append(len(found) + 2)
    h, of = np.array(flat, np.uint64), np.repeat(np.arange(len(lines)), sizes)
    if not len(h):
        return np.empty(0, np.int64), of, np.empty(0, bool)
    same = of[1:] == of[:-1]
    return (h[:-1] * _FIRST + h[1:] * _SECOND)[same].view(np.int64), of[1:][same], (h[1:] == np.uint64(_NUMBER))[same]


def _lines_of(body: str) -> tuple[list[str], list[bool], list[int]]:
    """Cleaned lines, whether each is prose, and the token of each whole line."""
    lines = [" ".join(raw.split()) for raw in _INVISIBLE.sub("", body).split("\n")]
    return lines, [is_prose(line) for line in lines], [line_hash(line) if line else 0 for line in lines]


def _surroundings(prose: list[bool], hashes: list[int]) -> list[int]:
    """One of 64 bits for the prose line that follows each line, or else precedes it."""
    out, after = [0] * len(prose), 0
    for i in range(len(prose) - 1, -1, -1):
        out[i] = after
        if prose[i]:
            after = 1 << (hashes[i] & 63)
    before = 1
    for i, is_long in enumerate(prose):
        out[i] = out[i] or before
        if is_long:
            before = 1 << (hashes[i] & 63)
    return out


def _of_body(body: str, words: _Words) -> dict[int, int]:
    """Tokens of a page; whole lines with their surroundings."""
    lines, prose, hashes = _lines_of(body)
    found = dict.fromkeys(pairs_of([line for line, is_long in zip(lines, prose, strict=True) if line and not is_long], words)[0].tolist(), 0)
    for h, around in zip(hashes, _surroundings(prose, hashes), strict=True):
        if h:
            found[h] = found.get(h, 0) | around
    return found


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each part of a host, summed within a batch: pages, titles, fingerprint of the pages and surroundings."""
    hosts = _Known()
    for batch in batches:
        for at in range(0, len(batch), 4000):
            part = batch.iloc[at : at + 4000]
            places = list(zip(part["host"].tolist(), part["salt"].tolist(), strict=True))
            names = {p: i for i, p in enumerate(dict.fromkeys(places))}
            place_no, mark, gram, title, around = [], [], [], [], []
            for place, site, key, head, body in zip(places, part["site"], part["key"], part["title"], part["body"], strict=True):
                words = hosts[site]
                for flag, found in ((0, _of_body(body, words)), (1, dict.fromkeys(pairs_of([clean(head)], words)[0].tolist(), 0) if head else {})):
                    gram.append(np.fromiter(found, np.int64, len(found)))
                    around.append(np.fromiter(found.values(), np.uint64, len(found)).view(np.int64))
                    place_no.append(np.full(len(found), names[place], np.int64))
                    # A page counts once in the vector for its lines and once for its title.
                    mark.append(np.full(len(found), _signed(word_hash(f"{key} {flag} {len(body)}")), np.int64))
                    title.append(np.full(len(found), flag, np.int64))
            gram, place_no, mark, title, around = map(np.concatenate, (gram, place_no, mark, title, around))
            if not len(gram):
                continue
            order = np.lexsort((gram, place_no))
            gram, place_no, mark, title, around = gram[order], place_no[order], mark[order], title[order], around[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (place_no[1:] != place_no[:-1])]))
            titles = np.add.reduceat(title, first)
            known = np.array(list(names), np.int64)[place_no[first]]
            yield pd.DataFrame({
                "host": known[:, 0], "salt": known[:, 1].astype(np.int32), "gram": gram[first],
                "n": np.diff(np.append(first, len(gram))) - titles, "titles": titles,
                "fp": np.bitwise_xor.reduceat(mark, first), "around": np.bitwise_or.reduceat(around, first),
            })


_TOKENS = "host bigint, salt int, gram bigint, n bigint, titles bigint, fp bigint, around bigint"


def _pages(df: DataFrame, key: str, url: str, title: str, body: str) -> DataFrame:
    """``key, site, salt, title, body``; a host's pages fall into parts of about :data:`PART` characters."""
    pages = df.select(F.col(key).alias("key"), site_of(F.col(url)).alias("site"), F.col(title).alias("title"), F.col(body).alias("body")).filter("site is not null and body is not null")
    # As a table its size is known, so that few hosts are broadcast and many shuffled.
    sizes = cut(pages.groupBy("site").agg(F.ceil(F.sum(F.length("body")) / PART).cast("int").alias("salts")), "sites")
    # Tables of tokens name a host by a hash of 64 bits.
    return pages.join(sizes, "site").select("key", "site", F.xxhash64("site").alias("host"), F.pmod(F.xxhash64("key"), F.greatest("salts", F.lit(1))).cast("int").alias("salt"), "title", "body")


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """``host, salt, gram, n, titles, seen, class, size`` of every token that recurs on its host.

    ``n`` and ``titles`` count pages and titles of the whole host, ``seen`` the
    different surroundings of a whole line, ``class`` names the equivalence
    class and ``size`` its tokens.
    """
    sums = (F.sum("n").alias("n"), F.sum("titles").alias("titles"), F.expr("bit_xor(fp)").alias("fp"), F.expr("bit_or(around)").alias("around"))
    parts = cut(pages.mapInPandas(_occurrences, _TOKENS).groupBy("host", "salt", "gram").agg(*sums), "grams")
    hosts = parts.groupBy("host", "gram").agg(*sums).filter((F.col("n") > 1) | (F.col("titles") >= SUPPORT))
    hosts = cut(hosts.withColumn("class", F.xxhash64("n", "titles", "fp")), "hosts")
    sizes = hosts.filter(F.col("n") >= SUPPORT).groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"))
    known = hosts.join(sizes, ["host", "class"], "left").select("host", "gram", "n", "titles", F.bit_count("around").alias("seen"), "class", F.coalesce("size", F.lit(1)).alias("size"))
    return parts.select("host", "salt", "gram").join(known, ["host", "gram"])


_NONE = (0, 0, 0, 0, 0)


class _Examiner:
    """Marks the lines of pages and checks the classes on them, by the tokens ``gram: (n, titles, seen, class, size)`` of one part of a host."""

    def __init__(self):
        self.words, self.known = _Words(""), {}
        self.classes: dict[tuple[int, int, int], list[int]] = {}

    def lines(self, body: str) -> list[tuple[int, int | None, int | None, bool, int]]:
        """``line_no, frame, class, whole, marks`` of every line that may be furniture."""
        lines, prose, hashes = _lines_of(body)
        known, short = self.known, []
        wholes = [known.get(h, _NONE) if h else _NONE for h in hashes]
        main = [i for i, is_long in enumerate(prose) if is_long and wholes[i][0] < WHOLE]
        # Without prose there is no main slot to lie outside of.
        begin, end = (main[0], main[-1]) if main else (0, len(lines))
        whole = [(i + 1, None, None, True, 0) for i, w in enumerate(wholes) if w[0] >= WHOLE]
        numbers = [i for i, line in enumerate(lines) if line and not prose[i]]
        grams, of, is_number = pairs_of([lines[i] for i in numbers], self.words)
        ends, grams = np.searchsorted(of, np.arange(len(numbers) + 1)).tolist(), grams.tolist()
        sequence: list[tuple[int, int]] = []
        for no, i in enumerate(numbers):
            own = grams[ends[no] : ends[no + 1]]
            found = [known.get(g, _NONE) for g in own]
            sequence += [(f[3], g) for g, f in zip(own, found, strict=True) if f[4] > 1 and f[0] >= SUPPORT]
            if wholes[i][0] >= WHOLE:
                continue
            marks = CONSTANT * (wholes[i][0] > 1 and wholes[i][2] > 1) + OUTSIDE * (i < begin or i > end)
            marks += HEADLINE * (sum(t >= SUPPORT and 3 * t >= n for n, t, *_ in found) >= 3)
            marks += NUMBERS * (all(f[0] >= SUPPORT for f in found) and bool(is_number[ends[no] : ends[no + 1]].any()))
            at = 0 if found[0][0] >= found[-1][0] else -1
            frame = found[at] if found[at][0] >= SUPPORT else None
            short.append((i + 1, own[at] if frame else None, frame[3] if frame else None, False, marks))
        self._check(sequence)
        return whole + short

    def _check(self, sequence: list[tuple[int, int]]) -> None:
        """Order, crossings and enclosing class of each class on a page, by the first place of each token."""
        members: dict[int, dict[int, None]] = {}
        for c, g in sequence:
            members.setdefault(c, {}).setdefault(g)
        left = {c: len(m) for c, m in members.items()}
        open_, seen, crossed, parent = [], set(), set(), {}
        for c, g in sequence:
            if g in seen:
                continue
            seen.add(g)
            if c not in parent:
                parent[c] = open_[-1] if open_ else 0
                open_.append(c)
            # Whatever is still open above the class is torn apart by its token.
            crossed.update(o for o in open_[open_.index(c) + 1 :])
            left[c] -= 1
            open_ = [o for o in open_ if left[o]]
        for c, m in members.items():
            order = xxhash.xxh64_intdigest(np.fromiter(m, np.int64, len(m)).tobytes()) - (1 << 63)
            count = self.classes.setdefault((c, order, parent[c]), [0, 0])
            count[0] += 1
            count[1] += c in crossed

    def drain(self) -> dict[tuple[int, int, int], list[int]]:
        out, self.classes = self.classes, {}
        return out


_EXAMINED = "host bigint, key string, line_no int, frame bigint, class bigint, whole boolean, marks int, word_order bigint, parent bigint, n bigint, crossed bigint"


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads the tokens of a part of a host, then its pages; gives rows of lines and rows of classes."""
    place, at = None, None
    for batch in batches:
        lines, classes = [], []

        def drain(host: int, examiner: _Examiner, classes: list = classes) -> None:
            classes += [(host, c, order, parent, n, crossed) for (c, order, parent), (n, crossed) in examiner.drain().items()]

        columns = ("host", "salt", "site", "key", "body", "gram", "n", "titles", "seen", "class", "size")
        for host, salt, site, key, body, gram, n, titles, seen, cls, size in zip(*(batch[c].tolist() for c in columns), strict=True):
            if (host, salt) != place:
                if at:
                    drain(place[0], at)
                place, at = (host, salt), _Examiner()
            if site is not None and site != at.words.site:
                at.words = _Words(site)
            if body is None:
                at.known[int(gram)] = (int(n), int(titles), int(seen), int(cls), int(size))
            else:
                lines += [(host, key, *row) for row in at.lines(body)]
        if at:
            drain(place[0], at)
        yield pd.DataFrame({
            "host": [x[0] for x in lines] + [x[0] for x in classes],
            "key": pd.Series([x[1] for x in lines] + [None] * len(classes), dtype=object),
            "line_no": pd.array([x[2] for x in lines] + [None] * len(classes), "Int32"),
            "frame": pd.array([x[3] for x in lines] + [None] * len(classes), "Int64"),
            "class": pd.array([x[4] for x in lines] + [x[1] for x in classes], "Int64"),
            "whole": pd.array([x[5] for x in lines] + [None] * len(classes), "boolean"),
            "marks": pd.array([x[6] for x in lines] + [None] * len(classes), "Int32"),
            "word_order": pd.array([None] * len(lines) + [x[2] for x in classes], "Int64"),
            "parent": pd.array([None] * len(lines) + [x[3] for x in classes], "Int64"),
            "n": pd.array([None] * len(lines) + [x[4] for x in classes], "Int64"),
            "crossed": pd.array([None] * len(lines) + [x[5] for x in classes], "Int64"),
        })


def examined(pages: DataFrame) -> DataFrame:
    """Rows of lines and of classes, of every page."""
    known = occurrence_classes(pages)
    columns = ("n", "titles", "seen", "class", "size")
    # No number is null, since pandas would make floats of them; a row without a body is a token.
    none = F.lit(None).cast("string")
    tokens_first = known.select("host", "salt", F.lit(0).alias("turn"), none.alias("site"), none.alias("key"), none.alias("body"), "gram", *[F.col(c).cast("bigint").alias(c) for c in columns])
    pages_then = pages.select("host", "salt", F.lit(1).alias("turn"), "site", F.col("key").cast("string").alias("key"), "body", *[F.lit(0).cast("bigint").alias(c) for c in ("gram", *columns)])
    stream = tokens_first.unionByName(pages_then).repartition("host", "salt").sortWithinPartitions("host", "salt", "turn")
    rows = stream.mapInPandas(_examine, _EXAMINED)
    return cut(rows.withColumn("key", F.col("key").cast(pages.schema["key"].dataType)), "lines")


def class_table(rows: DataFrame) -> DataFrame:
    """``host, class, pages, ordered, nested, parent``: shares of pages on which a class keeps its order and is not crossed, and the class that most often encloses it (0 for the page itself)."""
    checks = rows.filter("n is not null")
    orders = checks.groupBy("host", "class", "word_order").agg(F.sum("n").alias("n"), F.sum("crossed").alias("crossed"))
    totals = orders.groupBy("host", "class").agg(F.sum("n").alias("pages"), F.max("n").alias("first"), F.sum("crossed").alias("crossed"))
    around = checks.groupBy("host", "class", "parent").agg(F.sum("n").alias("n"))
    parents = around.groupBy("host", "class").agg(F.max_by("parent", F.struct("n", "parent")).alias("parent"))
    return totals.join(parents, ["host", "class"]).select("host", "class", "pages", (F.col("first") / F.col("pages")).alias("ordered"), (1 - F.col("crossed") / F.col("pages")).alias("nested"), "parent")


def frame_table(rows: DataFrame) -> DataFrame:
    """``host, frame, class, lines, constant, outside, headline, numbers, marked, pooled, score, furniture``: what the lines of each frame of a valid class show."""
    lines = rows.filter("line_no is not null and not whole and frame is not null")
    invalid = class_table(rows).filter((F.col("ordered") < VALID) | (F.col("nested") < VALID)).select("host", "class")
    lines = lines.join(invalid, ["host", "class"], "left_anti")
    has = lambda bit, name: F.count_if(F.col("marks").bitwiseAND(F.lit(bit)) != 0).alias(name)
    hosts = lines.groupBy("host", "frame", "class").agg(
        F.count(F.lit(1)).alias("lines"), has(CONSTANT, "constant"), has(OUTSIDE, "outside"), has(HEADLINE, "headline"), has(NUMBERS, "numbers"), has(15, "marked")
    )
    hosts = cut(hosts, "frames")
    pooled = hosts.groupBy("frame").agg((F.sum("marked") / F.sum("lines")).alias("pooled"))
    score = (F.col("marked") + PRIOR * F.col("pooled")) / (F.col("lines") + PRIOR)
    return hosts.join(pooled, "frame").withColumn("score", score).withColumn("furniture", F.col("score") >= MARKED)


def furniture(df: DataFrame, key: str = "article_id", url: str = "url", title: str = "title", body: str = "body") -> DataFrame:
    """``key, line_no`` of every non-blank line that is not article text.

    Rows without a url have no host and so no template, and rows without a body
    no lines; both give nothing. Equal keys are judged row by row. Other columns
    are ignored, and an empty table gives an empty result. A host of a few pages
    has hardly any classes; its lines go by their own marks.
    """
    rows = examined(_pages(df, key, url, title, body))
    verdicts = frame_table(rows).select("host", "frame", "furniture")
    lines = rows.filter("line_no is not null").join(verdicts, ["host", "frame"], "left")
    # A line without a frame of a valid class goes by its own marks.
    gone = F.col("whole") | F.coalesce("furniture", F.col("marks") != 0)
    return lines.filter(gone).select("key", F.col("line_no").cast("bigint").alias("line_no"))
