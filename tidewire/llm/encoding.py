"""Text that was decoded with the wrong encoding (problem 10).

Garbling only ever touches characters beyond ASCII, so each run of such
characters is judged by itself, once per distinct run of the whole corpus: it
is encoded with each candidate legacy encoding, decoded strictly as UTF-8, and
again for nested layers, as long as the garbling cost falls.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import cut

#: Single-byte encodings that UTF-8 is commonly misread as.
CANDIDATES = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "koi8-r", "cp866")
RUN = r"[^\x00-\x7F]+"
_PIECES = r"[^\x00-\x7F]+|[\x00-\x7F]+"
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: What is left of a garbled sequence after one of its characters got lost.
_REMAINS = re.compile("\ufffd|\u00e2\u20ac|\u00ef\u00bf\u00bd|\u00ef\u00bb\u00bf|[\u00c2\u00c3](?=[\u00a0-\u00bf\u2010-\u203f\u20ac\u2122])")


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of the same number, as web decoders have it."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


# Where the letters of widely written scripts beyond Europe stand, from Hebrew to Georgian, and of East Asia.
_BEYOND = ((0x0531, 0x0590), (0x05BE, 0x05F5), (0x0600, 0x0700), (0x0900, 0x0E80), (0x1000, 0x1100), (0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFFEF))


def _beyond(char: str) -> bool:
    """A letter or sign of a script written beyond Europe."""
    return any(a <= ord(char) < b for a, b in _BEYOND) and unicodedata.category(char)[0] in "LMNP"


def _plausible(char: str) -> bool:
    """A character that news text may hold."""
    code = ord(char)
    if code < 0xA0:
        return False
    if _beyond(char):
        return True
    return code < 0x180 or 0x218 <= code < 0x21C or 0x386 <= code < 0x3CF or 0x400 <= code < 0x460 or 0x490 <= code < 0x492 or 0x2009 <= code < 0x203F or 0x20A0 <= code < 0x20C0 or 0x2100 <= code < 0x2300 or 0x25A0 <= code < 0x2800 or code >= 0x1F000


def cost(run: str) -> int:
    """Garbling cost: one per character, and more for controls, replacement marks and characters no text of these languages holds."""
    return sum(1 if _plausible(c) and unicodedata.category(c) != "So" else 3 for c in run)


def _encode(run: str, encoding: str) -> bytes | None:
    table = _bytes_of(encoding)
    try:
        return bytes(table[c] for c in run)
    except KeyError:
        return None


def _whole(run: str, encoding: str) -> str | None:
    raw = _encode(run, encoding)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _in_parts(run: str, encoding: str) -> str | None:
    """Decode the sequences within a run that are strictly UTF-8, and leave letters between them."""
    table, out, i, changed = _bytes_of(encoding), [], 0, False
    while i < len(run):
        for size in (4, 3, 2):
            raw = bytes(table.get(c, 0) for c in run[i : i + size])
            if len(raw) == size and _SEQUENCE.fullmatch(raw):
                try:
                    char = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                # Two letters in a row are ordinary text.
                if (_plausible(char) or char.isalpha() and char in table) and not run[i : i + size].isalpha():
                    out.append(char)
                    i, changed = i + size, True
                    break
        else:
            out.append(run[i])
            i += 1
    return "".join(out) if changed else None


def repair(run: str) -> str:
    """The run with every layer of wrong decoding undone; the run itself if none can be."""
    # The cost falls with every layer, so there is a last one.
    while True:
        best = run
        for how in (_whole, _in_parts):
            for encoding in CANDIDATES:
                fixed = how(run, encoding)
                # An inner layer may hold controls; the last one may not.
                if fixed is None or (n := sum(map(_beyond, fixed))) == 1 or n and run.isalpha():
                    # One letter may be chance, and a word of letters alone is no other script.
                    continue
                if cost(fixed) < cost(best) and (how is _in_parts or all(_plausible(c) or c in _bytes_of("cp1252") or c in _bytes_of("latin-1") for c in fixed)):
                    best = fixed
            if best != run:
                break
        if best == run:
            return run
        run = best


def judge(run: str) -> tuple[str, bool]:
    """The repaired run and whether the run is garbled, restorable or not."""
    fixed = repair(run)
    lost = _REMAINS.search(fixed) is not None or any("\x80" <= c < "\xa0" and c != "\x85" for c in fixed)
    return fixed, fixed != run or lost


def _judge_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        judged = [judge(r) for r in batch["run"]]
        yield pd.DataFrame({"run": batch["run"], "fixed": [f for f, _ in judged], "bad": [b for _, b in judged]})


def _runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))


def garbled_runs(texts: DataFrame) -> DataFrame:
    """``run, fixed`` for every distinct garbled run of ``texts (key, text)``."""
    distinct = texts.select(F.explode(_runs(F.col("text"))).alias("run")).distinct()
    return cut(distinct.mapInPandas(_judge_all, "run string, fixed string, bad boolean").filter("bad").select("run", "fixed"), "runs")


def repair_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, lost`` for every row whose text holds a garbled sequence.

    ``text`` is restored wherever nothing was lost, and ``lost`` says whether
    something was (a replacement character, or a byte that is missing). Rows
    with a null or empty text are not affected. A key that occurs twice is
    judged row by row. Other columns of ``df`` are ignored.
    """
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dictionary = garbled_runs(texts)
    with_runs = texts.withColumn("_row", F.xxhash64("text")).filter(F.col("text").rlike(RUN))
    pairs = with_runs.select("key", "_row", F.explode(_runs(F.col("text"))).alias("run")).join(dictionary, "run")
    maps = pairs.groupBy("key", "_row").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("run", "fixed")))).alias("_map"))
    found = with_runs.join(maps, ["key", "_row"])
    pieces = F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))
    fixed = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("_map", p), p)), "")
    return found.select("key", fixed.alias("text")).withColumn("lost", F.col("text").rlike(r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"))


def garbled_keys(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct keys of the rows that :func:`repair_texts` returns, without rebuilding any text."""
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dictionary = garbled_runs(texts)
    return texts.select("key", F.explode(_runs(F.col("text"))).alias("run")).join(dictionary, "run", "left_semi").select("key").distinct()
