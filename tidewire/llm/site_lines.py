"""Lines that one site repeats across its documents (problem 3).

Every distinct spelling of a line keeps its documents as compressed bitmaps:
one container per range of 32,768 document keys, which holds sorted offsets
while they are few and plain bits beyond. The containers of spellings that
differ only in case or white space are united, cardinalities are counted
exactly, and a line of a document goes if its bit is set in a bitmap above the
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import line_key, site_of
from tidewire.runtime import cut

#: Bits of one bitmap; fixed by bitmap_construct_agg.
CHUNK = 32768
#: Occurrences of a line in one range up to which its container holds offsets.
SPARSE = 2048
KEY = ("site", "k1", "k2")


def lines_of(df: DataFrame, doc: str, url: str, body: str, keep_raw: bool = False) -> DataFrame:
    """One row per non-blank line: ``doc_key, site, line_no, k1, k2, variant``."""
    split = df.select(F.col(doc).alias("doc_key"), site_of(F.col(url)).alias("site"), F.posexplode(F.split(F.col(body), "\n", -1)).alias("pos", "line"))
    keyed = split.filter("site is not null and doc_key is not null").withColumn("norm", line_key(F.col("line"))).filter("norm <> ''")
    return keyed.select("doc_key", "site", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.xxhash64("norm").alias("k1"), F.hash("norm").alias("k2"), F.xxhash64("line").alias("variant"), *(["norm"] if keep_raw else []))


def _chunk(key: Column) -> Column:
    return F.floor(key / CHUNK)


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(CHUNK))


def line_bitmaps(occurrences: DataFrame) -> DataFrame:
    """``site, k1, k2, chunk, offsets, bits`` of ``occurrences`` with a column ``n``, how many there are in the range: the united bitmaps of all spellings of each line."""
    offset = F.pmod("doc_key", F.lit(CHUNK)).cast("int")
    few = occurrences.filter(F.col("n") <= SPARSE).groupBy(*KEY, "variant", "chunk").agg(F.collect_set(offset).alias("o"))
    few = few.groupBy(*KEY, "chunk").agg(F.array_distinct(F.flatten(F.collect_list("o"))).alias("o")).select(*KEY, "chunk", F.array_sort("o").alias("offsets"), F.lit(None).cast("binary").alias("bits"))
    many = occurrences.filter(F.col("n") > SPARSE).groupBy(*KEY, "variant", "chunk").agg(F.expr(f"bitmap_construct_agg(pmod(doc_key, {CHUNK}))").alias("bits"))
    many = many.groupBy(*KEY, "chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).select(*KEY, "chunk", F.lit(None).cast("array<int>").alias("offsets"), "bits")
    return few.unionByName(many)


def cardinality() -> Column:
    """Documents of a container."""
    return F.when(F.col("bits").isNull(), F.size("offsets").cast("bigint")).otherwise(F.expr("bitmap_count(bits)"))


def repeated_lines(df: DataFrame, doc: str = "article_id", url: str = "url", body: str = "body", least: int = 10) -> DataFrame:
    """Occurrences of lines that at least ``least`` documents of one site hold.

    Returns ``doc_key, line_no``. Rows without url, key or body have no lines
    here; an empty table gives an empty result; other columns of ``df`` are
    ignored, whatever their names. The same key twice counts as one document.
    """
    # Bodies are taken apart once.
    occurrences = cut(lines_of(df, doc, url, body).withColumn("chunk", _chunk(F.col("doc_key"))), "occurrences")
    # A line with fewer occurrences than the threshold can't have enough documents.
    frequent = cut(occurrences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*KEY), "frequent")
    kept = cut(occurrences.join(frequent, list(KEY), "left_semi"), "repeated")
    # The chunk is part of the key: a line in a third of all documents is spread over all chunks.
    sizes = cut(kept.groupBy(*KEY, "chunk").agg(F.count(F.lit(1)).alias("n")), "sizes")
    bitmaps = cut(line_bitmaps(kept.join(sizes, [*KEY, "chunk"])), "bitmaps")
    enough = bitmaps.groupBy(*KEY).agg(F.sum(cardinality()).alias("docs")).filter(F.col("docs") >= least)
    found = bitmaps.join(enough.select(*KEY), list(KEY), "left_semi")
    looked_up = kept.join(found, [*KEY, "chunk"])
    byte = F.conv(F.hex(F.substring("bits", (_bit(F.col("doc_key")) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.when(F.col("bits").isNull(), F.array_contains("offsets", _bit(F.col("doc_key")).cast("int"))).otherwise(F.getbit(byte, (_bit(F.col("doc_key")) % 8).cast("int")) == 1)
    return looked_up.filter(is_set).select("doc_key", "line_no").distinct()


def without_lines(df: DataFrame, lines: DataFrame, doc: str = "article_id", body: str = "body") -> DataFrame:
    """``doc_key, body`` of each row, without the lines that ``lines (doc_key, line_no)`` names."""
    drop = lines.groupBy("doc_key").agg(F.collect_set("line_no").alias("_drop"))
    texts = df.select(F.col(doc).alias("doc_key"), F.col(body).alias("body"))
    kept = F.filter(F.split("body", "\n", -1), lambda x, i: ~F.array_contains("_drop", (i + 1).cast("bigint")))
    return texts.join(drop, "doc_key", "left").select("doc_key", F.when(F.col("_drop").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("body"))
