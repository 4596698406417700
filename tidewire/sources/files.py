"""Readers and writers with explicit schemas and stated behaviour on bad input."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.contracts import ContractError

#: Lines that a version-control merge leaves in a file.
CONFLICT = "^(<{7}|={7}|>{7})"
#: Columns of the prediction sink.
PREDICTIONS = ("date", "split", "model", "y_true_clf", "y_pred_clf", "correct_clf", "kurs_today", "y_true_reg", "y_pred_reg", "err_reg", "dir_true", "dir_pred", "dir_hit")


def read_text_csv(spark: SparkSession, path: str, columns: list[str], skip_conflicts: bool = True) -> DataFrame:
    """A CSV with a header, every column as text; missing columns are an error, conflict lines are skipped or an error."""
    head = spark.read.option("header", True).csv(path)
    if missing := [c for c in columns if c not in head.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    first = F.coalesce(F.col(f"`{head.columns[0]}`"), F.lit(""))
    if not skip_conflicts and not head.filter(first.rlike(CONFLICT)).isEmpty():
        raise ContractError(f"{path} holds merge conflict lines")
    return head.filter(~first.rlike(CONFLICT)).select(*columns)


def read_csv_inferred(spark: SparkSession, path: str, columns: list[str] | None = None, dates: dict[str, str] | None = None) -> DataFrame:
    """A CSV with inferred types; ``columns`` prunes it, ``dates`` names columns with the pattern of their dates."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    for name, pattern in (dates or {}).items():
        df = df.withColumn(name, F.coalesce(F.try_to_date(F.col(name).cast("string"), pattern), F.try_to_date(F.col(name).cast("string"), "yyyy-MM-dd")))
    return df.select(*columns) if columns else df


def read_json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A list of records, or one record, of a JSON file; or of each of its ``lines``."""
    if not lines:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    text, value = spark.read.text(path), F.trim("value")
    records = F.when(value.startswith("["), F.from_json(value, f"array<struct<{', '.join(':'.join(f.strip().split(' ')) for f in schema.split(','))}>>"))
    one = F.array(F.from_json(value, schema))
    return text.select(F.explode(F.coalesce(records, one)).alias("r")).select("r.*")


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """``name, html`` of every page of a folder in order of name; an empty folder is an error."""
    pages = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("html"))
    if pages.isEmpty():
        raise ContractError(f"no pages in {path}")
    return pages.orderBy("name")


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured feed files: ``title_rss, rss_link, published_rss, source, source_url``."""
    schema = "title string, link string, pubDate string, source struct<_VALUE:string,_url:string>"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return items.select(F.col("title").alias("title_rss"), F.col("link").alias("rss_link"), F.col("pubDate").alias("published_rss"), F.col("source._VALUE").alias("source"), F.col("source._url").alias("source_url"))


def read_dictionary(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """``word, category`` of a wide master dictionary: a member if the column is above zero."""
    wide = spark.read.option("header", True).csv(path).select("Word", *categories)
    long = wide.unpivot(["Word"], categories, "category", "year")
    return long.filter(F.col("year").try_cast("int") > 0).select(F.lower("Word").alias("word"), F.lower("category").alias("category"))


def _finite(dims: int) -> Column:
    return (F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _needed(df: DataFrame, needed: DataFrame | None) -> DataFrame:
    return df.join(needed.select("term").distinct(), "term", "left_semi") if needed is not None else df


def read_vectors(spark: SparkSession, path: str, dims: int, needed: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``term, vector`` of a text file of vectors, an ``N D`` header skipped; only the terms of ``needed (term)`` if given.

    Lines of another dimension or with values that aren't finite numbers are
    left out, or an error if ``strict``.
    """
    parts = F.split(F.trim("value"), " ")
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\d+ \d+$") & (F.trim("value") != "")).select(F.get(parts, F.lit(0)).alias("term"), F.transform(F.slice(parts, 2, 1_000_000), lambda x: x.try_cast("float")).alias("vector"))
    if strict and (bad := lines.filter(~_finite(dims)).select("term").limit(1).collect()):
        raise ContractError(f"{path}: {bad[0][0]!r} has no vector of {dims} numbers")
    return _needed(lines.filter(_finite(dims)), needed)


def _binary_vectors(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Vectors of the binary word2vec layout: ``N D`` and a line end, then each word, a blank and D floats."""
    head, _, rest = raw.partition(b"\n")
    count, dims = map(int, head.split())
    at = 0
    for _ in range(count):
        end = rest.index(b" ", at)
        word = rest[at:end].lstrip(b"\n").decode("utf-8", "replace")
        at = end + 1 + 4 * dims
        yield word, np.frombuffer(rest[end + 1 : at], "<f4")


def read_packed_vectors(spark: SparkSession, path: str, dims: int, needed: DataFrame | None = None, member: str | None = None, cache: str | None = None) -> DataFrame:
    """``term, vector`` of a binary word2vec file, or of a text or binary member of a zip file.

    A file is read by one task, which gives its vectors in batches. With
    ``cache`` the result is kept there as Parquet and read from there the next
    time. Another dimension is an error.
    """
    if cache and _exists(spark, cache):
        return _needed(spark.read.parquet(cache), needed)

    out = unpacked_vectors(spark.read.format("binaryFile").load(path).select("content"), dims, member)
    if cache:
        out.write.mode("overwrite").parquet(cache)
        out = spark.read.parquet(cache)
    return _needed(out, needed)


def unpacked_vectors(df: DataFrame, dims: int, member: str | None = None, keep: str | None = None) -> DataFrame:
    """``term, vector`` of the files in the column ``content``, and the column ``keep`` of each."""

    def of(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
        if raw[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(raw)) as packed:
                raw = packed.read(member or packed.namelist()[0])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            yield from _binary_vectors(raw)
            return
        for line in text.split("\n"):
            parts = line.rstrip().split(" ")
            if len(parts) > 2:
                yield parts[0], np.array(parts[1:], np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch[keep] if keep else [None] * len(batch), batch["content"], strict=True):
                terms, vectors = [], []
                for term, vector in of(bytes(raw)):
                    if len(vector) != dims:
                        raise ContractError(f"{term!r} has {len(vector)} numbers, not {dims}")
                    terms.append(term), vectors.append(vector)
                    if len(terms) == 5000:
                        yield pd.DataFrame({"term": terms, "vector": vectors} | ({keep: name} if keep else {}))
                        terms, vectors = [], []
                if terms:
                    yield pd.DataFrame({"term": terms, "vector": vectors} | ({keep: name} if keep else {}))

    schema = "term string, vector array<float>" + (f", {keep} {df.schema[keep].dataType.simpleString()}" if keep else "")
    return df.mapInPandas(run, schema).filter(_finite(dims))


def binary_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    """The binary word2vec layout of a small list of vectors."""
    dims = len(rows[0][1]) if rows else 0
    return f"{len(rows)} {dims}\n".encode() + b"".join(t.encode() + b" " + struct.pack(f"<{dims}f", *v) + b"\n" for t, v in rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def preview(df: DataFrame) -> DataFrame:
    """The five columns of the preview sink, texts cut to 500 characters; what a row lacks is null."""
    names = ("title", "category", "p_geopolitics", "p_rate")
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    return df.select(*have, F.substring("text_final", 1, 500).alias("text_final"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_stages(frames: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per stage that has rows."""
    for name, df in frames.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def predictions(df: DataFrame, model: str) -> DataFrame:
    """The prediction sink's columns from ``date, split, y_true_clf, y_pred_clf, kurs_today, y_true_reg, y_pred_reg``."""
    up = lambda c: F.signum(F.col(c) - F.col("kurs_today")).cast("int")
    out = df.withColumn("model", F.lit(model)).withColumn("correct_clf", (F.col("y_true_clf") == F.col("y_pred_clf")).cast("int"))
    out = out.withColumn("err_reg", F.round(F.col("y_pred_reg") - F.col("y_true_reg"), 6)).withColumn("dir_true", up("y_true_reg")).withColumn("dir_pred", up("y_pred_reg"))
    return out.withColumn("dir_hit", (F.col("dir_true") == F.col("dir_pred")).cast("int")).select(*PREDICTIONS)


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _path(spark, path)
    return files.exists(hadoop)


def clean_outputs(spark: SparkSession, root: str, allowed: tuple[str, ...]) -> list[str]:
    """Delete what is there of the ``allowed`` relative paths below ``root``, and nothing else; returns what went."""
    if bad := [a for a in allowed if a.startswith(("/", "~")) or ".." in a.split("/") or not a.strip("./")]:
        raise ContractError(f"not below {root}: {', '.join(bad)}")
    gone = [a for a in allowed if _exists(spark, f"{root}/{a}")]
    for a in gone:
        hadoop, files = _path(spark, f"{root}/{a}")
        files.delete(hadoop, True)
    return gone


def require_outputs(spark: SparkSession, paths: list[str]) -> None:
    """All paths exist, or an error that names those that don't."""
    if missing := [p for p in paths if not _exists(spark, p)]:
        raise ContractError(f"missing: {', '.join(missing)}")


def resume(todo: DataFrame, store: str, key: str, load) -> DataFrame:
    """Load what ``store`` doesn't hold and append it; a run that was cut off goes on where it stopped."""
    spark = todo.sparkSession
    there = _exists(spark, store)
    rest = todo.join(spark.read.parquet(store).select(key).distinct(), key, "left_anti") if there else todo
    load(rest).write.mode("append").parquet(store)
    return spark.read.parquet(store)


#: Elements that hold no text of the article.
_SKIP = frozenset({"script", "style", "noscript", "nav", "footer", "header"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Where the paragraphs of an article stand, the most specific place first: a class, an element or a part of a class.
_PLACES = (("class", "ArticleBody-articleBody"), ("class", "article-content"), ("tag", "article"), ("part", "ArticleBody"), ("part", "article-body"))


@dataclass
class _Element:
    tag: str
    places: frozenset[int]
    text: list[str] | None = None


def _squeezed(pieces: list[str]) -> str:
    return " ".join(" ".join(pieces).split())


class _Page(HTMLParser):
    """Fields, paragraphs and linked data of a page. Open elements are a stack, so that an inner end tag closes nothing but its own element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.title, self.time, self.author, self.heading = None, None, None, None
        self.scripts: list[str] = []
        self.script = False
        # Text, places and whether within the first article element; furniture is left out of the latter.
        self.paragraphs: list[tuple[str, frozenset[int], bool, bool]] = []
        self.main: _Element | None = None
        self.loose: list[str] = []
        self.main_text: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "time" and self.time is None and "datetime" in a:
            self.time = a["datetime"]
        if tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append("")
            self.script = True
        if tag == "p":
            # A paragraph ends the one before it.
            self._close("p")
        if tag in _VOID:
            return
        names = a.get("class", "").split()
        places = frozenset(i for i, (kind, name) in enumerate(_PLACES) if (kind == "class" and name in names) or (kind == "tag" and name == tag) or (kind == "part" and name in a.get("class", "")))
        keep = tag in ("title", "p", "h1") or tag == "a" and "Author-authorName" in names
        element = _Element(tag if tag != "a" or not keep else "a author", places, [] if keep else None)
        if self.main is None and places & {2, 3}:
            self.main = element
        self.stack.append(element)

    def _close(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag.split()[0] == tag), None)
        if at is None:
            return
        for element in reversed(self.stack[at:]):
            self._end(element)
            self.stack.pop()

    def _end(self, element: _Element) -> None:
        if element.text is None:
            return
        text = _squeezed(element.text) or None
        if element.tag == "title" and self.title is None:
            self.title = text
        elif element.tag == "a author" and self.author is None:
            self.author = text
        elif element.tag == "h1" and self.heading is None:
            self.heading = text
        elif element.tag == "p" and text:
            places = frozenset().union(*(e.places for e in self.stack))
            self.paragraphs.append((text, places, any(e is self.main for e in self.stack), any(e.tag in _SKIP for e in self.stack)))

    def handle_endtag(self, tag):
        self.script = self.script and tag != "script"
        self._close(tag)

    def handle_data(self, data):
        if self.script:
            self.scripts[-1] += data
        if any(e.tag in ("script", "style") for e in self.stack):
            return
        for element in self.stack:
            if element.text is not None:
                element.text.append(data)
        if not any(e.tag in _SKIP or e.tag == "title" for e in self.stack):
            self.loose.append(data)
            if any(e is self.main for e in self.stack):
                self.main_text.append(data)

    def close(self):
        super().close()
        while self.stack:
            self._end(self.stack[-1])
            self.stack.pop()


def _parsed(page: str) -> _Page:
    parser = _Page()
    parser.feed(page)
    parser.close()
    return parser


def page_fields(page: str | None) -> tuple:
    """Title, time, author, body, linked-data scripts, first heading and article text of a page; nulls for an empty one.

    The body is the paragraphs of the first article element, or else of the
    page, or else all its text; the article text is the distinct paragraphs of
    the most specific place that has three.
    """
    if not page or not page.strip():
        return (None,) * 7
    at = _parsed(page)
    shown = [text for text, _, main, skipped in at.paragraphs if not skipped and (main or at.main is None)]
    body = "\n".join(shown) or _squeezed(at.main_text if at.main else at.loose) or None
    article: list[str] = []
    for i in range(len(_PLACES)):
        found = [text for text, places, _, _ in at.paragraphs if i in places]
        if len(found) >= 3:
            article = list(dict.fromkeys(found))
            break
    return at.title, at.time, at.author, body, at.scripts, at.heading, "\n".join(article) or None


_PAGE = "title string, published_at string, author string, body string, linked_data array<string>, heading string, article_text string"


def extract_pages(df: DataFrame, key: str, page: str) -> DataFrame:
    """``key, title, published_at, author, body, linked_data, heading, article_text`` of html pages, by :func:`page_fields`."""
    names = ["title", "published_at", "author", "body", "linked_data", "heading", "article_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([page_fields(p) for p in batch["_page"]], columns=names)
            yield rows.assign(key=batch["key"].to_numpy())[["key", *names]]

    rows = df.select(F.col(key).alias("key"), F.col(page).alias("_page"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, {_PAGE}")


def linked_items(scripts: Column) -> Column:
    """All items of linked-data scripts as variants: lists are flattened, bad scripts skipped."""
    parsed = F.filter(F.transform(scripts, lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def linked_articles(df: DataFrame, scripts: str, heading: str | None = None) -> DataFrame:
    """Adds ``headline, date_published, authors, article_body`` from the articles in linked data.

    Of all items of an article type or with a headline, the first value of each
    field counts; ``@type`` may be one or many, ``author`` too. Without a
    headline the page's ``heading`` is taken. Rows without an article keep
    nulls.
    """
    text = lambda v, path: F.try_variant_get(v, path, "string")
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(text(v, "$['@type']")))
    wanted = lambda v: F.coalesce(F.arrays_overlap(kinds(v), F.array(F.lit("NewsArticle"), F.lit("Article"))), F.lit(False)) | text(v, "$.headline").isNotNull()
    names = lambda v: F.nullif(F.array_join(F.transform(F.try_variant_get(v, "$.author", "array<variant>"), lambda a: text(a, "$.name")), ", "), F.lit(""))
    rows = df.withColumn("_items", linked_items(F.col(scripts))).withColumn("_articles", F.filter("_items", wanted))
    first = lambda items, value: F.get(F.filter(F.transform(items, value), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    headline = first("_articles", lambda v: text(v, "$.headline"))
    return rows.withColumns({
        "headline": F.coalesce(headline, F.col(heading)) if heading else headline,
        "date_published": first("_articles", lambda v: text(v, "$.datePublished")),
        "authors": first("_articles", lambda v: F.coalesce(names(v), text(v, "$.author.name"))),
        "article_body": first("_items", lambda v: F.trim(text(v, "$.articleBody"))),
    }).drop("_items", "_articles")


def scraped(df: DataFrame, key: str, page: str, least: int = 300) -> DataFrame:
    """``key, title, published_at, author, body, status, error`` of fetched pages by their linked data and article text; never an exception."""
    pages = linked_articles(extract_pages(df, key, page), "linked_data", "heading")
    out = pages.select("key", F.col("headline").alias("title"), F.col("date_published").alias("published_at"), F.col("authors").alias("author"), F.coalesce("article_text", "article_body").alias("body"))
    return page_status(out, F.col("body"), least)


def resolved(df: DataFrame, link: str, lookup: DataFrame) -> DataFrame:
    """Adds ``url``: what ``lookup (link, url)`` says a redirecting link leads to, or null."""
    return df.join(lookup.select(F.col("link").alias(link), "url").dropDuplicates([link]), link, "left")


def page_status(df: DataFrame, body: str, least: int = 300) -> DataFrame:
    """Adds ``status`` and ``error``: a missing or short body is a failure, never an exception."""
    size = F.length(F.coalesce(F.trim(body), F.lit("")))
    return df.withColumn("status", F.when(size >= least, "success").otherwise("failed")).withColumn("error", F.when(size < least, F.concat(F.lit("body too short ("), size.cast("string"), F.lit(")"))))
