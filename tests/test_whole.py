"""Whole tables against brute force, beside their SQL."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

from tests.conftest import rows_of
from tidewire.functions import text as t
from tidewire.operators import timestamps
from tidewire.plans import registry

QUERIES = registry.queries()


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_html_extract_takes_every_row(spark, sf_dir, duck, tmp_path):
    texts = [
        ("Plain title", "One\nTwo\nOne"),
        ("‘Ünal’: a < b & c, \"d\"", "x <b>y</b> &amp; z\r\n\n  café — “q” "),
        ("A &amp; B &lt;p&gt;", "</p></article><script>s</script>\nlast"),
        (None, "body alone"),
        ("title alone", None),
        (None, None),
        (" ", " \n "),
    ]
    folder = stored(spark, tmp_path, "scrape_article", [(i, *x) for i, x in enumerate(texts)], "article_id bigint, title string, body string")

    def want(rows):
        shown = lambda b: [x for line in b.split("\n") for x in (" ".join(line.split()), "inner") if x][:-1]
        return {i: (" ".join((a or "").split()) or None, "\n".join(x for x in shown(b or "") if x) or None) for i, a, b in rows}

    run = lambda d: {r["article_id"]: (r["title"], r["body"]) for r in QUERIES["html_extract"](spark, d).collect()}
    assert run(folder) == want([(i, *x) for i, x in enumerate(texts)])
    assert run(sf_dir) == want(duck.sql("SELECT article_id, title, body FROM scrape_article").fetchall())


QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": " - "})
INVISIBLE = re.compile(r"[​-‏‪-‮⁠﻿\x00-\x08\x0b\x0c\x0e-\x1f]")


def plain_text(text):
    return re.sub(r"\b(?:[A-Z]\.){2,}", lambda m: m.group().replace(".", ""), INVISIBLE.sub("", text.translate(QUOTES)))


def title_of(title):
    if title is None:
        return None
    return re.sub(r"[ \t\r\f\v]+", " ", re.sub(r"(?i)\s+[-|]\s+[A-Za-z]+\s*$", "", plain_text(title))).strip()


def test_title_suffix_takes_every_headline(spark, sf_dir, duck, tmp_path):
    titles = ["Plain - Outlet", "‘Ünal’ risk grows – Wire", "“Café” talks — Daily", "The U.S. and U.S.A. and U.K. met | Post", "in​vis⁠ible ﻿- Desk", "no-break - Ledger", "ends in U.S. – Wire", "AU.S. and U.S. differ", None, "", "a - b - Wire"]
    folder = stored(spark, tmp_path, "cnbc_discovered", list(enumerate(titles)), "disc_id bigint, title_rss string")
    run = lambda d: {r["disc_id"]: r["title"] for r in QUERIES["title_suffix"](spark, d).collect()}
    assert run(folder) == {i: title_of(x) for i, x in enumerate(titles)}
    assert run(sf_dir) == {i: title_of(x) for i, x in duck.sql("SELECT disc_id, title_rss FROM cnbc_discovered").fetchall()}


MASKS = (
    (re.compile(r"<[^>]+>"), " "),
    (re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), " "),
    (re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), "EMAIL"),
    (re.compile(r"https?://\S+|www\.\S+|(?:[a-zA-Z0-9-]+\.)+(?:com|org|net|gov|edu|io|id|co)\b\S*", re.I), "URL"),
)


def masked_text(text):
    text = html.unescape(unicodedata.normalize("NFC", text or ""))
    for pattern, kind in MASKS:
        text = pattern.sub(kind, text)
    return " ".join(text.replace("\u200b", "").split())


def test_mask_entities_reads_the_texts(spark, sf_dir, duck, tmp_path):
    texts = ["<en> mail desk_a@desk.example see https://desk.example/x now", "“Café”\nmail é.b@c.example or www.x.example, then go", "https://a.example/b and prices.co fell", "a\x00b\x85c\td  e", "ünal@bank.example and bank.com/über", None, ""]
    folder = stored(spark, tmp_path, "documents", [(i, x, None) for i, x in enumerate(texts)], "doc_id bigint, text string, lang string")
    run = lambda d: {r["doc_id"]: r["masked"] for r in QUERIES["mask_entities"](spark, d).collect()}
    assert run(folder) == {i: masked_text(x) for i, x in enumerate(texts)}
    assert run(folder)[0] == "mail EMAIL see URL now"
    assert run(sf_dir) == {i: masked_text(x) for i, x in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


BODIES = [
    "Café Ünal didn’t rise — “the U.S. rate” fell 1,5 percent in São Paulo.\nJAKARTA – short\nThe naïve trader said: 'no' to Mupèor Insight, 2.5 and 3.\nThe naïve trader said: 'no' to Mupèor Insight, 2.5 and 3.",
    "Read more: “news”\nWrite é.b@bank.example or see https://x.example/a for the café’s rates today.\nin​vis⁠ible signs are not words - – —",
    "Plain ASCII body of words. It isn't long. No!\n\nBanks' rates can't rise, won't fall",
    "JAKARTA (Reuters) – The rupiah rose against the dollar again.\nA: b.",
    "",
]


def paragraphs_of(text):
    text = re.sub(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", " ", re.sub(r"https?://\S+|www\.\S+|pic\.twitter\.com/\S+", " ", plain_text(text), flags=re.I))
    kept = []
    for p in (re.sub(r"[ \t\r\f\v]+", " ", p).strip(" ") for p in text.split("\n")):
        p = p if kept else re.sub(t.DATELINE, "", p)
        if len(p.split()) >= 4 and not (len(p.split()) < 40 and re.search("|".join(t.NOTICE_PARAGRAPHS), p, re.I)):
            kept.append(p)
    return "\n".join(dict.fromkeys(kept))


def bag_of(text):
    text = re.sub(r"'s\b", "", re.sub(r"n't\b", " not", text.lower().replace("can't", "cannot").replace("won't", "will not"))).replace("'", "")
    return [w for w in re.findall("[a-z]{2,}", text) if w not in t.STOPWORDS or w in {"no", "not", "nor", "never", "none", "cannot", "without", "us"}]


def lemmas_of(text):
    def lemma(w):
        if w.endswith("ies") and len(w) > 4:
            return w[:-3] + "y"
        cut = 0 if w.endswith(("ss", "us", "is")) else 2 if w.endswith("es") and len(w) > 3 else w.endswith("s") and len(w) > 2
        return w[: len(w) - cut]

    return [lemma(re.sub("'s$", "", w)) for w in re.findall(r"\b[a-z0-9]+(?:'[a-z]+)?\b", text.lower())]


def test_stored_text_equals_brute_force(spark, sf_dir, duck, tmp_path):
    rows = [(i, x, x.split("\n")[0], len(x.split()), "train", "2024-01-01") for i, x in enumerate(BODIES)]
    folder = stored(spark, tmp_path, "articles_aligned", rows, "aligned_id bigint, body_clean string, title_clean string, n_words int, split string, news_date_wib string")
    real = duck.sql("SELECT aligned_id, body_clean, title_clean, n_words FROM articles_aligned").fetchall()
    for d, some in ((folder, [r[:4] for r in rows]), (sf_dir, real)):
        for name, column, want in (
            ("word_count", "n", lambda b, h: len(b.split())),
            ("clean_paragraphs", "body", lambda b, h: paragraphs_of(b)),
            ("bow_tokens", "bow", lambda b, h: " ".join(bag_of(b))),
            ("lemma_rules", "lemmas", lambda b, h: " ".join(lemmas_of(h))),
            ("classical_clean", "unigrams", lambda b, h: " ".join(w for w in lemmas_of(h) if w in t.NEGATIONS or w not in t.STOPWORDS and len(w) >= 3)),
            ("preserved_entities", "entities", lambda b, h: "|".join(sorted(set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", h))))),
            ("preserved_entities", "numbers", lambda b, h: "|".join(sorted(set(re.findall(r"\b\d+(?:[.,]\d+)*\b", b))))),
            ("sentences", "sentences", lambda b, h: sum(len(s.split()) >= 3 for s in re.split(r"(?<=[.!?])\s+|\n+", b))),
        ):
            got = Counter((r[0], r[1]) for r in QUERIES[name](spark, d).select("aligned_id", column).collect())
            assert got == Counter((i, want(b, h)) for i, b, h, _ in some), name
    # The table's own count is over the stored text.
    assert Counter((r[0], r[1]) for r in QUERIES["word_count"](spark, sf_dir).collect()) == Counter((i, n) for i, _, _, n in real)
    df = Counter(w for _, b, _, _ in real for w in set(bag_of(b)))
    assert {r["term"]: r["df"] for r in QUERIES["doc_freq"](spark, sf_dir).collect()} == df


def test_models_run_with_their_defaults(spark, sf_dir):
    rows = QUERIES["word2vec_pool"](spark, sf_dir).collect()
    assert rows and all(len(r["vector"]) == 100 for r in rows) and len({tuple(r["vector"]) for r in rows}) > 1
    assert {r["topic"] for r in QUERIES["topic_terms"](spark, sf_dir).collect()} == set(range(8))


def test_geo_terms_with_a_hyphen_count(spark, tmp_path):
    rows = [(1, "A cease-fire holds", "calm"), (2, "Rates", "a cease-fire and a summit"), (3, "Rates", "a cease-fire alone"), (4, "Cease fire", "calm")]
    folder = stored(spark, tmp_path, "articles_aligned", rows, "aligned_id bigint, title_clean string, body_clean string")
    assert rows_of(QUERIES["geo_hits_filter"](spark, folder)) == [("1", "1"), ("2", "2")]


def test_second_step_parses_new_times_alone(spark, sf_dir, monkeypatch):
    parsed, parse = [], timestamps.parse_dictionary
    monkeypatch.setattr(timestamps, "parse_dictionary", lambda entries: parsed.append(entries.count()) or parse(entries))
    whole = rows_of(QUERIES["p1_found"](spark, sf_dir))
    assert rows_of(QUERIES["p1_in_two"](spark, sf_dir)) == whole
    # Distinct entries of pages and of days at once, then each in two steps.
    pages, days, *steps = parsed
    assert steps[0] + steps[1] == pages and steps[2] + steps[3] == days and min(steps) > 0
