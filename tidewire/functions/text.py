"""Column expressions for text that several operators share."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """Every run of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def line_key(line: Column) -> Column:
    """What two lines have in common that differ only in case or white space."""
    return F.lower(squeeze(line))


def site_of(url: Column) -> Column:
    """Host of a url in lower case without a leading ``www.``, ``m.`` or ``amp.``; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^(?:www|m|amp)\.", ""), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of ``a``-``z`` and ``0``-``9`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# Patterns and word lists that results depend on.
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
URL = r"(?iU)https?://\S+|www\.\S+|pic\.twitter\.com/\S+"
URL_BROAD = r"(?iU)https?://\S+|www\.\S+|(?:[a-zA-Z0-9-]+\.)+(?:com|org|net|gov|edu|io|id|co)\b\S*"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
TAG = "<[^>]+>"
DATELINE = r"^[A-Z][A-Za-z.,' ]{2,40}\s+\((?:Reuters|AP)\)\s*-\s*"
# A letter and its dot at the start of an acronym or right after one of its dots.
ACRONYM = r"(?U)(?:(?!\A)\G|\b(?=[A-Z]\.[A-Z]\.))([A-Z])\."
NOTICE_PARAGRAPHS = (
    r"^(watch|read more|read|related|listen|see also|more from|sign up|subscribe|click here|follow)\b\s*[:\-]",
    r"\bcnbc pro\b",
    r"\bsubscribe to\b",
    r"\bsign up for\b",
    r"\bnewsletter\b",
    r"contributed to this (report|story|article)",
    r"^(disclaimer|copyright)\b",
    r"all rights reserved",
    r"^this (story|article) is (still )?developing",
    r"^(get|receive) the latest",
)
NOISE_TITLES = (r"stocks? making the biggest moves", r"biggest analyst calls", r"\bcramer\b", r"mad money", r"options action", r"trading nation", r"^watch live")
KEYWORD_GROUPS = {
    "conflict": ("war", "conflict", "military", "missile", "airstrike", "invasion", "ceasefire", "troops", "defense"),
    "sanction": ("sanction", "embargo", "asset freeze", "export control", "trade restriction"),
    "diplomacy": ("diplomatic", "summit", "bilateral", "treaty", "negotiation", "foreign minister"),
    "trade": ("tariff", "trade war", "trade dispute", "export ban", "import restriction"),
    "political_risk": ("election", "coup", "protest", "political crisis", "government collapse"),
}
GEO_TERMS = (
    "war", "invasion", "invade", "conflict", "ceasefire", "cease-fire", "military", "troops", "missile", "airstrike", "nuclear", "sanctions", "sanction", "embargo",
    "blockade", "terrorism", "escalation", "escalate", "hostilities", "geopolitical", "geopolitics", "tariff", "tariffs", "trade war", "export controls", "diplomatic",
    "diplomacy", "summit", "treaty", "nato", "united nations", "opec", "ukraine", "russia", "kremlin", "putin", "zelensky", "gaza", "hamas", "israel", "hezbollah", "iran",
    "taiwan", "north korea", "middle east", "red sea", "strait of hormuz", "south china sea", "beijing", "xi jinping",
)
NEGATIONS = (
    "no", "not", "nor", "neither", "never", "none", "nobody", "nowhere", "nothing", "hardly", "scarcely", "barely", "without", "cannot",
    "dont", "don't", "doesnt", "doesn't", "didnt", "didn't", "wont", "won't", "wouldnt", "wouldn't", "cant", "can't", "couldnt", "couldn't", "shouldnt", "shouldn't",
    "isnt", "isn't", "arent", "aren't", "wasnt", "wasn't", "werent", "weren't", "havent", "haven't", "hasnt", "hasn't", "hadnt", "hadn't",
    "tidak", "bukan", "jangan", "belum", "tak", "tiada", "tanpa",
)
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "of", "off", "on", "once", "only", "or", "other", "ought", "our", "ours",
    "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "with", "would", "you", "your", "yours", "yourself", "yourselves",
)


def normal_form(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, in Arrow batches: no built-in expression has it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run(text)


def unescaped(text: Column) -> Column:
    """Character references as the characters they stand for, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)

    return run(text)


def composed(text: Column, form: str = "NFC") -> Column:
    """:func:`normal_form`, then :func:`unescaped`, in one pass."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        plain = lambda t: t if t.isascii() else unicodedata.normalize(form, t)
        return texts.map(lambda t: t if t is None else html.unescape(plain(t)) if "&" in t else plain(t))

    return run(text)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms_pattern(terms: tuple[str, ...]) -> str:
    """One alternation over terms, the longest first, at word borders of any script."""
    escaped = sorted((t.replace("-", r"\-") for t in set(terms)), key=lambda t: (-len(t), t))
    return r"(?U)(?<!\w)(?:" + "|".join(escaped) + r")(?!\w)"


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """Distinct lower-case terms in first-seen order; a longer term hides the shorter ones inside it."""
    return F.array_distinct(matches(F.lower(F.coalesce(text, F.lit(""))), terms_pattern(terms)))


def keyword_terms() -> tuple[str, ...]:
    return tuple(t for group in KEYWORD_GROUPS.values() for t in group)


def field_matches(title: Column, body: Column, discovery_title: Column) -> Column:
    """Distinct keywords of each of three fields, in first-seen order."""
    terms = keyword_terms()
    return F.struct(term_hits(title, terms).alias("title"), term_hits(body, terms).alias("body"), term_hits(discovery_title, terms).alias("discovery_title"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def sentences(text: Column, least_words: int = 3) -> Column:
    """Sentences and lines of at least so many words."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: word_count(s) >= least_words)


def plain_quotes(text: Column) -> Column:
    """Typographic quotes and dashes as ASCII; the long dash gets blanks."""
    return F.replace(F.translate(text, "’‘“”–", "''\"\"-"), F.lit("—"), F.lit(" - "))


def joined_acronyms(text: Column) -> Column:
    """``U.S.`` as ``US``."""
    return F.regexp_replace(text, ACRONYM, "$1")


def normal_url(url: Column) -> Column:
    """Lower case, without query, fragment, ``www.`` and trailing slashes."""
    cut = F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(cut, r"//www\.", "//"), "/+$", "")


def text_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def masked(text: Column) -> Column:
    """E-mail addresses, then urls, as their kind."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "EMAIL"), URL_BROAD, "URL")


def clean_title(title: Column, suffix: str) -> Column:
    """Plain quotes, joined acronyms, without a trailing outlet name."""
    plain = joined_acronyms(F.regexp_replace(plain_quotes(title), INVISIBLE, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?iU)\s+[-|]\s+" + suffix + r"\s*$", ""), r"[ \t\r\f\x0b]+", " "))


def clean_paragraphs(text: Column, least_words: int = 4, notice_words: int = 40) -> Column:
    """Paragraphs without urls, short lines, notices and repeats; the dateline of the first kept one goes."""
    plain = joined_acronyms(F.regexp_replace(plain_quotes(text), INVISIBLE, ""))
    plain = F.regexp_replace(F.regexp_replace(plain, URL, " "), EMAIL, " ")
    parts = F.filter(F.transform(F.split(plain, "\n", -1), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\f\x0b]+", " "))), lambda p: p != "")
    notice = "(?i)" + "|".join(NOTICE_PARAGRAPHS)

    def step(kept: Column, p: Column) -> Column:
        q = F.when(F.size(kept) == 0, F.regexp_replace(p, DATELINE, "")).otherwise(p)
        drop = (word_count(q) < least_words) | ((word_count(q) < notice_words) & q.rlike(notice))
        return F.when(drop, kept).otherwise(F.array_append(kept, q))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.array_distinct(kept), "\n")


def bag_of_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case words of two letters and more without stop words; negations stay."""
    t = F.replace(F.replace(F.lower(text), F.lit("can't"), F.lit("cannot")), F.lit("won't"), F.lit("will not"))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)n't\b", " not"), r"(?U)'s\b", "")
    keep = {"no", "not", "nor", "never", "none", "cannot", "without", "us"}
    stop = [w for w in stopwords if w not in keep]
    # A long list of literals becomes a hash set.
    return F.array_join(F.filter(matches(F.replace(t, F.lit("'"), F.lit("")), "[a-z]{2,}"), lambda w: ~w.isin(*stop)), " ")


def word_tokens(text: Column) -> Column:
    """Words with an inner apostrophe, lower case, without a possessive ``'s``."""
    return F.transform(matches(F.lower(text), r"(?U)\b[a-z0-9]+(?:'[a-z]+)?\b"), lambda w: F.regexp_replace(w, "'s$", ""))


def lemma(word: Column) -> Column:
    """Plural endings by rule."""
    plain = ~(word.endswith("ss") | word.endswith("us") | word.endswith("is"))
    size = F.length(word)
    return (
        F.when(word.endswith("ies") & (size > 4), F.concat(F.expr("''"), F.substring(word, F.lit(1), size - 3), F.lit("y")))
        .when(word.endswith("es") & (size > 3) & plain, F.substring(word, F.lit(1), size - 2))
        .when(word.endswith("s") & (size > 2) & plain, F.substring(word, F.lit(1), size - 1))
        .otherwise(word)
    )


def classical_tokens(text: Column, least: int = 3, stopwords: tuple[str, ...] = STOPWORDS, lemmatize: bool = True) -> Column:
    """Lemmas without stop words and short words; negations stay."""
    stop = [w for w in stopwords if w not in NEGATIONS]
    lemmas = F.transform(word_tokens(text), lemma) if lemmatize else word_tokens(text)
    known = (lambda w: ~w.isin(*stop)) if stop else (lambda w: F.lit(True))
    return F.filter(lemmas, lambda w: known(w) & ((F.length(w) >= least) | w.isin(*NEGATIONS)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by underscores; none of fewer tokens."""
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws("_", w, *[F.get(tokens, i + k) for k in range(1, n)]))


def bigrams(tokens: Column) -> Column:
    return ngrams(tokens, 2)


def embedding_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits of any script, with an inner apostrophe."""
    return matches(F.lower(text), r"(?U)[^\W_]+(?:'[^\W_]+)?")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct ``n``-word sequences; a shorter text is one sequence, and one without words the empty one."""
    ws = words(text)
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.array_distinct(some)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def deduplicated(text: Column, similar: float = 0.8) -> Column:
    """``kept, n_exact, n_near`` of a text's paragraphs, greedily.

    A paragraph goes if it equals a kept one (case and blanks aside) or shares
    enough shingles with it; paragraphs without words are alike if they are the
    same. Empty paragraphs don't count.
    """
    parts = F.filter(F.transform(F.split(text, "\n+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    # Keys and shingles are made once per paragraph, not once per comparison.
    prepared = F.transform(parts, lambda p: F.struct(p.alias("p"), line_key(p).alias("k"), F.filter(shingles(p), lambda x: x != "").alias("s")))
    start = F.struct(F.array().cast("array<struct<p:string,k:string,s:array<string>>>").alias("kept"), F.lit(0).alias("n_exact"), F.lit(0).alias("n_near"))

    def step(acc: Column, p: Column) -> Column:
        same = F.exists(acc["kept"], lambda q: q["k"] == p["k"])
        # Sets of too different sizes can't share enough; only the others are compared.
        close = lambda q: F.least(F.size(q["s"]), F.size(p["s"])) >= similar * F.greatest(F.size(q["s"]), F.size(p["s"])) - 1e-9
        alike = lambda q: F.when((F.size(q["s"]) > 0) & (F.size(p["s"]) > 0), close(q) & (jaccard(q["s"], p["s"]) >= similar)).otherwise(q["p"] == p["p"])
        near = ~same & F.exists(acc["kept"], alike)
        kept = F.when(same | near, acc["kept"]).otherwise(F.array_append(acc["kept"], p))
        return F.struct(kept.alias("kept"), (acc["n_exact"] + same.cast("int")).alias("n_exact"), (acc["n_near"] + near.cast("int")).alias("n_near"))

    out = lambda acc: F.struct(F.transform(acc["kept"], lambda q: q["p"]).alias("kept"), acc["n_exact"], acc["n_near"])
    return F.aggregate(prepared, start, step, out)


def unique_paragraphs(text: Column, similar: float = 0.8) -> Column:
    """The kept paragraphs of :func:`deduplicated`."""
    return deduplicated(text, similar)["kept"]


def light_clean(text: Column, deduplicate: bool = True, similar: float = 0.8, keep_lines: bool = False) -> Column:
    """Composed and unescaped, without tags and control characters, addresses masked, paragraphs deduplicated, blanks squeezed; empty for null."""
    plain = masked(F.regexp_replace(F.regexp_replace(composed(F.coalesce(text, F.lit(""))), TAG, " "), CONTROL, " "))
    if deduplicate:
        # A single paragraph comes out as it is, but for the blanks around it, which go anyway.
        plain = F.array_join(unique_paragraphs(plain, similar), "\n\n" if keep_lines else " ")
    plain = F.replace(plain, F.lit("\u200b"), F.lit(""))
    if not keep_lines:
        return squeeze(plain)
    lines = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\S\r\n]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def entities(text: Column) -> Column:
    """Runs of capitalised words, distinct and sorted."""
    return F.array_sort(F.array_distinct(matches(text, r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b")))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(matches(text, r"(?U)\b\d+(?:[.,]\d+)*\b")))


def fnv1a(text: Column, buckets: int) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, modulo ``buckets``."""
    hexed = F.hex(F.encode(text, "utf-8"))
    steps = F.sequence(F.lit(1), F.greatest(F.length(hexed) / 2, F.lit(0)).cast("int"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    start = F.lit(2166136261).cast("bigint")
    return F.pmod(F.when(F.length(hexed) == 0, start).otherwise(F.aggregate(steps, start, lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(4294967295)))), F.lit(buckets))


def character_grams(word: Column, least: int = 3, most: int = 6) -> Column:
    """Distinct substrings of the word between border marks; the whole word if it is shorter than ``least``."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    by_size = [of_size(n) for n in range(least, most + 1)]
    grams = F.array_distinct(F.flatten(F.array(*by_size)))
    return F.when(F.size(grams) == 0, F.array(marked)).otherwise(grams)
