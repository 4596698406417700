"""Registered queries of the language-model operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import boilerplate, encoding, lookalikes, mixing, near_duplicates, packing, residue, site_lines, split_overlap
from tidewire.llm.tokens import token_counts
from tidewire.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation article with nearly the same body."""
    return split_overlap.pairs_of_rows(*split_overlap.overlaps(table(spark, sf_dir, "articles_aligned")))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and site."""
    articles = table(spark, sf_dir, "articles_aligned")
    return split_overlap.report(articles, *split_overlap.overlaps(articles))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least ten articles of one site hold."""
    return site_lines.repeated_lines(table(spark, sf_dir, "scrape_article")).select(F.col("doc_key").alias("article_id"), "line_no")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article's body without its site's repeated lines."""
    articles = table(spark, sf_dir, "scrape_article")
    return site_lines.without_lines(articles, site_lines.repeated_lines(articles)).withColumnRenamed("doc_key", "article_id")


def _furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "scrape_article")
    # Pages that hold no article have no body to keep, and teach no template.
    excluded = cut(residue.residue(articles).select(F.col("key").alias("article_id")).distinct(), "excluded")
    return boilerplate.furniture(articles.join(excluded, "article_id", "left_anti")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page that are not article text."""
    return _furniture(spark, sf_dir).withColumnRenamed("key", "article_id")


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body as its article alone."""
    lines = _furniture(spark, sf_dir).withColumnRenamed("key", "doc_key")
    return site_lines.without_lines(table(spark, sf_dir, "scrape_article"), lines).withColumnRenamed("doc_key", "article_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title or body is template residue, filler, an error page or a notice."""
    return residue.residue(table(spark, sf_dir, "scrape_article")).select(F.col("key").alias("article_id")).distinct()


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to exclude, with what was found where."""
    return residue.residue(table(spark, sf_dir, "scrape_article")).withColumnRenamed("key", "article_id")


#: Texts of problem 6: table, key, text and likeness.
_NEAR = (("scrape_article", "article_id", "body", near_duplicates.BODIES), ("cnbc_discovered", "disc_id", "title_rss", near_duplicates.TITLES))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-same bodies and of near-same titles."""
    a, b = (near_duplicates.all_pairs(*near_duplicates.linked_representatives(table(spark, sf_dir, t), k, c, kind)).select(F.lit(t).alias("src"), "id_a", "id_b") for t, k, c, kind in _NEAR)
    return a.unionByName(b)


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text with its class of copies and its number of links."""
    a, b = (near_duplicates.groups(*near_duplicates.linked_representatives(table(spark, sf_dir, t), k, c, kind)).select(F.lit(t).alias("src"), F.col("key").alias("row_id"), F.col("rep").alias("class_id"), "links") for t, k, c, kind in _NEAR)
    return a.unionByName(b)


#: Texts of problem 7: table, key and text.
_LOOKS = (("scrape_article", "article_id", "body"), ("cnbc_discovered", "disc_id", "title_rss"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text looks ordinary but is made of other characters."""
    a, b = (lookalikes.keys_with_kinds(table(spark, sf_dir, t), k, c).select(F.lit(t).alias("src"), F.col("key").alias("row_id")) for t, k, c in _LOOKS)
    return a.unionByName(b)


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that were not in the one form, in it, with what was found in them."""
    a, b = (lookalikes.one_form(table(spark, sf_dir, t), k, c).select(F.lit(t).alias("src"), F.col("key").alias("row_id"), "text", F.array_join("kinds", " ").alias("kinds")) for t, k, c in _LOOKS)
    return a.unionByName(b)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    specs = table(spark, sf_dir, "pack_spec")
    return packing.pack(sizes, specs), specs


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each capacity."""
    return _packed(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(*_packed(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).withColumnRenamed("key", "doc_id").drop("members")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a garbled sequence."""
    return encoding.garbled_keys(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents, restored where nothing was lost."""
    return encoding.repair_texts(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    own = (p2_found, p2_report, p3_found, p3_bodies, p4_found, p4_bodies, p5_found, p5_kinds, p6_found, p6_groups, p7_found, p7_texts, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_texts)
    return {q.__name__: q for q in own}


_SITE = "nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^(www|m|amp)\\.', ''), '')"
#: White space as Unicode has it.
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = f"""
WITH pages AS (SELECT article_id, {_SITE} AS site, string_split(body, chr(10)) AS parts FROM scrape_article WHERE body IS NOT NULL),
lines AS (SELECT article_id, site, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM pages WHERE site IS NOT NULL),
keyed AS (SELECT article_id, site, line_no, lower(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'))) AS k FROM lines),
often AS (SELECT site, k FROM keyed WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT article_id) >= 10)
"""

_P3 = _LINES + "SELECT article_id, line_no FROM keyed JOIN often USING (site, k)"


_SETS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"


def _alike(rows: str, least: float, match: str) -> str:
    """Pairs ``a, b`` of ``rows (id, side, s)`` whose sets ``s`` share at least ``least`` of all their elements."""
    return f"""r AS ({rows}), e AS (SELECT id, side, len(s) AS n, unnest(s) AS g FROM r),
c AS (SELECT a.id AS a, b.id AS b, a.n AS m, b.n AS n, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND {match} GROUP BY 1, 2, 3, 4),
p AS (SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM c WHERE k >= {least}::DOUBLE * (m + n - k))"""


_P2 = f"""WITH {_alike(f"SELECT id, side, {_SETS} AS s FROM (SELECT DISTINCT aligned_id AS id, split = 'train' AS side, regexp_extract_all(lower(body_clean), '[a-z0-9]+', 0) AS w FROM articles_aligned WHERE body_clean IS NOT NULL AND split IS NOT NULL) WHERE len(w) >= 3", 0.6, "a.side AND NOT b.side")}
SELECT id_a, id_b FROM p"""
_BODY_SETS = f"SELECT id, true AS side, {_SETS} AS s FROM (SELECT article_id AS id, regexp_extract_all(lower(body), '[a-z0-9]+', 0) AS w FROM scrape_article WHERE body IS NOT NULL) WHERE len(w) >= 60"
_TITLE_SETS = "SELECT id, true AS side, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, CAST(i AS INT), 3))) AS s FROM (SELECT disc_id AS id, trim(regexp_replace(lower(title_rss), '[^a-z0-9]+', ' ', 'g')) AS t FROM cnbc_discovered WHERE title_rss IS NOT NULL) WHERE length(t) >= 20"
_P6 = f"""SELECT 'scrape_article' AS src, id_a, id_b FROM (WITH {_alike(_BODY_SETS, 0.6, "a.id < b.id")} SELECT * FROM p)
UNION ALL SELECT 'cnbc_discovered', id_a, id_b FROM (WITH {_alike(_TITLE_SETS, 0.8, "a.id < b.id")} SELECT * FROM p)"""
#: Letters in full width and ligatures, marks, invisible characters, and blanks other than the ordinary one.
_ODD = r"[\p{M}\p{Cf}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ff01}-\x{ffee}\x{fb00}-\x{fb4f}]"


def _disguised(text: str) -> str:
    words = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{Cf}}]+', 0)"
    mixed = f"list_filter({words}, lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '[^\\P{{L}}\\p{{Latin}}\\p{{Common}}\\p{{Inherited}}]'))"
    return f"(regexp_matches({text}, '{_ODD}') OR len({mixed}) > 0)"


_P7 = f"""SELECT 'scrape_article' AS src, article_id AS row_id FROM scrape_article WHERE {_disguised('body')}
UNION ALL SELECT 'cnbc_discovered', disc_id FROM cnbc_discovered WHERE {_disguised('title_rss')}"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p3_found": _P3, "p6_found": _P6, "p7_found": _P7}
