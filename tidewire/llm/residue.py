"""Template residue, filler text, error pages and script notices (problem 5).

Character 4-gram models of three kinds of residue are fitted on seed phrases,
one of natural prose on the whole corpus; a second set over character shapes
(capital, small letter, digit, the sign itself) knows placeholders by their
brackets. Windows whose log-likelihood ratio favours residue are residue, and a
row goes by how much of its title, of a line or of its body they cover.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed phrases of each kind, as web servers, frameworks, layout tools and content systems write them.
NOTICES = """
404 Not Found. The requested URL /news/2020/some-page-title-here could not be found on this server. Return to the home page or try a search. Page not found
404 – the page you are looking for does not exist or has been moved. Go back to the front page. Reference a1b2c3d4e5f6
403 Forbidden. Access denied. You do not have permission to access this resource. Access to this page has been denied. Access Denied. Incident ID 9f8e7d6c5b4a
Your IP address has been blocked. Request blocked. Error 403 Error 404 Error 500 Error 503
500 Internal Server Error. The server encountered an internal error and was unable to complete your request.
502 Bad Gateway. The proxy server received an invalid response from an upstream server while loading some-page-title-here 0a1b2c3d4e5f
503 Service Unavailable. Service temporarily unavailable. We are down for scheduled maintenance; please check back soon. Maintenance window 5d4c3b2a1f0e. Requested: some-page-title
504 Gateway Time-out. The upstream server is taking too long to respond. Connection timed out. This site can't be reached.
429 Too Many Requests. You are sending too many requests from your network; please slow down and reload the page. Request id: 7c6b5a4f3e2d Ray ID 1a2b3c4d5e6f
Please enable JavaScript to view this page. Please turn on JavaScript and cookies to continue. You need to enable JavaScript to run this app: some-app-name
<noscript>This page requires JavaScript. Your browser does not run scripts or has scripts disabled. JavaScript is required</noscript>
Your browser session does not support scripts, which this site requires. Please update your browser. Please enable cookies.
Just a moment... Checking your browser before accessing the site. Checking that you are human. This may take a few seconds. Verify you are human before opening
Please wait while we verify your request. Please wait... Loading... Loading… Redirecting
Your session has expired. Please sign in again to continue. Your session for some-page-title has expired, log in again to go on (4f3e2d1c0b9a).
An unexpected error occurred (code 8a7b6c5d4e3f). Something went wrong. Our team has been told; please try again later. Oops! An error has occurred
Fatal error: Uncaught exception in /var/www/html/index.php on line 42, stack trace 3c2b1a0f9e8d. Warning: undefined variable. Notice: undefined index in /srv/www/page-name.php on line 7
Untitled document. Untitled page. Untitled document 1. New document. No title
undefined undefined null null undefined NaN undefined null [object Object] null undefined
Halaman tidak ditemukan. Halaman yang Anda cari tidak ditemukan. Silakan kembali ke beranda, kode 6e5d4c3b2a1f
Aktifkan JavaScript untuk melihat halaman ini. Aktifkan JavaScript untuk membaca some-page-title. Peramban Anda tidak mendukung skrip. Peramban tanpa JavaScript tidak didukung [2b3c4d5e6f7a]
Akses ditolak. Anda tidak memiliki izin untuk membuka halaman ini. Terjadi kesalahan. Silakan coba lagi nanti. Mohon tunggu sebentar. Sesi Anda telah berakhir, silakan masuk kembali.
"""
FILLERS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod gravida. Duis ac tellus et risus vulputate vehicula. Donec lobortis risus a elit, etiam tempor ut ullamcorper, ligula eu tempor congue, eros est euismod turpis, id tincidunt sapien risus a quam.
Lorem ipsum headline. Lorem ipsum title. Body text goes here, body text goes here. Article title goes here. Your text goes here. Headline goes here
TODO: replace this text with the final copy. TODO replace with final text. Sample paragraph for layout. Sample text for layout purposes only. Dummy text. Placeholder text. Insert text here. Text to come. TBD
"""
PLACEHOLDERS = """
{{ title }} {{title}} {{ article.title }} {{ user.name }} {{page_title}} {{{ body }}} ${title} ${author} ${user.first_name} ${page_date} $!{title}
[[title]] [[page_name]] [[author.name]] %TITLE% %AUTHOR_NAME% %FIRST_NAME% %%NAME%% @@TITLE@@ @@AUTHOR@@ @@PAGE_DATE@@ __TITLE__ ##NAME##
[INSERT TITLE] [INSERT NAME HERE] [INSERT DATE HERE] [NAME OF COMPANY] [NAME OF CITY] [YOUR NAME] [TITLE] [PHOTO CAPTION] [INSERT USER.NAME HERE]
<insert name> <insert figure here> <insert date> <your name> <title goes here> <name>
<%= title %> <%= page.title %> <% include header %> {% include "header" %} {% block content %} {% title %} {0} {1} {2} {name} {title} #{title} <?php echo title ?> <?= title ?>
"""
# Signs as prose uses them, counted as natural however small the corpus is.
PROSE = """
He said that “[the minister] did not know” of it. “It [the bank] will not move,” she wrote. The plan [sic] was kept. Prices rose 3.5% to $4.20, or 12 % more. See the note [1] and the list (a) to (c).
"""
SEEDS = {"notice": NOTICES, "filler": FILLERS, "placeholder": PLACEHOLDERS}
BINS = 1 << 16
#: Order of the letter grams by kind: invented words of filler share endings rather than longer strings.
ORDERS = {"notice": 4, "filler": 3, "placeholder": 4}
#: Signs that placeholders are made of, and that prose hardly has.
_MARKS = np.zeros(sys.maxunicode + 1, bool)
_MARKS[[ord(c) for c in set(PLACEHOLDERS) if not c.isalnum() and not c.isspace() and c not in ".?!\""]] = True
_SHAPES = np.arange(sys.maxunicode + 1, dtype=np.uint32)
_SHAPES[0xC0:][np.fromiter((chr(c).isalpha() for c in range(0xC0, sys.maxunicode + 1)), bool, sys.maxunicode + 1 - 0xC0)] = 97
for _lo, _hi, _to in ((48, 58, 57), (65, 91, 65), (97, 123, 97)):
    _SHAPES[_lo:_hi] = _to
_LOWER = np.arange(sys.maxunicode + 1, dtype=np.uint32)
_LOWER[65:91] += 32


_BLANKS, _INVISIBLE = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
_BLANKS[[0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]] = True
_INVISIBLE[[0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]] = True


def _codes(text: str) -> np.ndarray:
    """Code points; full-width signs and odd blanks as the ordinary ones, invisible characters left out."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 0xA0:
        codes = np.where((codes > 0xFF00) & (codes < 0xFF5F), codes - 0xFEE0, codes)
        codes = np.where(_BLANKS[codes], 32, codes)[~_INVISIBLE[codes]]
    return codes.astype(np.uint32)


def _bins(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashed gram that starts at each position; the text is padded at its end."""
    c = np.concatenate([codes, np.zeros(order - 1, np.uint32)]).astype(np.uint64)
    h = c[: len(codes)].copy()
    for i in range(1, order):
        h = h * np.uint64(0x100000001B3) + c[i : len(codes) + i]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def grams(text: str) -> dict[str, np.ndarray]:
    """Bins of three and four letters and of four shapes at each position."""
    codes = _codes(text)
    lower = _LOWER[codes]
    return {"3": _bins(lower, 3), "4": _bins(lower, 4), "shape": _bins(_SHAPES[codes], 4)}


Counts = dict[str, np.ndarray]
_PROSE_WEIGHT = 20


@dataclass(frozen=True)
class Limits:
    """Windows in characters, their mean ratios, and the coverage that makes residue."""

    window: int = 16
    ratio: float = 1.0
    title: float = 0.55
    line: float = 0.6
    body: float = 0.5
    shortest_line: int = 24
    shortest_filler: int = 60
    certain: float = 0.85
    filler_window: int = 40
    filler_ratio: float = 0.3
    mark_window: int = 6
    mark_ratio: float = 1.8


class Model:
    """Log-likelihood ratios of each kind of residue against natural prose, per bin."""

    def __init__(self, natural: Counts, found: dict[str, Counts] | None = None):
        """``natural`` counts the corpus; ``found`` the lines of it that a first model judged to be of each kind."""
        self.letters, self.shapes = {}, {}
        for kind, seed in SEEDS.items():
            own = {k: np.bincount(b, minlength=BINS).astype(float) for k, b in grams(seed).items()}
            rest = {k: natural[k] + _PROSE_WEIGHT * np.bincount(b, minlength=BINS).astype(float) for k, b in grams(PROSE).items()}
            for k in own:
                if found and kind in found:
                    own[k] += found[kind][k]
                    rest[k] = np.maximum(rest[k] - found[kind][k], 0)
            order = str(ORDERS[kind])
            self.letters[kind] = self._ratio(own[order], rest[order])
            self.shapes[kind] = self._ratio(own["shape"], rest["shape"])

    @staticmethod
    def _ratio(own: np.ndarray, natural: np.ndarray) -> np.ndarray:
        # Seeds are short, so their unseen grams get little mass and a floor.
        p = (own + 0.02) / (own.sum() + 0.02 * BINS)
        q = (natural + 0.5) / (natural.sum() + 0.5 * BINS)
        return np.clip(np.log(p) - np.log(q), -3.0, 7.0).astype(np.float32)


def _covered(ratio: np.ndarray, stop: np.ndarray, window: int, least: float, room: np.ndarray | int) -> np.ndarray:
    """Positions within a window whose mean ratio over ``room`` characters is high enough; windows end with their line."""
    at = np.arange(len(ratio))
    total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    ends = np.minimum(at + window, stop)
    ends = np.maximum(ends, at)
    flagged = np.flatnonzero((total[ends] - total[at]) / room >= least)
    steps = np.bincount(flagged, minlength=len(ratio) + 1) - np.bincount(ends[flagged], minlength=len(ratio) + 1)
    return np.cumsum(steps)[: len(ratio)] > 0


@dataclass
class _Lines:
    """Lines of several texts and how many of their characters each kind of residue covers."""

    bins: Counts
    starts: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    covered: dict[str, np.ndarray]


def _lines(texts: list[str], model: Model, limits: Limits, title: bool = False, kinds: tuple[str, ...] = tuple(SEEDS)) -> _Lines:
    joined = "\n\x00\n".join(texts) + "\n"
    bins, codes = grams(joined), _codes(joined)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text, sizes = np.cumsum(codes == 0)[starts], ends - starts
    stop, sizes_all = np.repeat(ends, sizes + 1), sizes
    inner = (sizes > 0) & (codes[starts] != 0)
    out = _Lines(bins, starts[inner], sizes[inner], text[inner], {})
    solid = (codes != 10) & (codes != 0)
    for kind in kinds:
        of_shapes = model.shapes[kind][bins["shape"]] if kind != "filler" else None
        if kind == "placeholder":
            # Only grams that hold one of the signs count.
            marked = np.convolve(_MARKS[codes], np.ones(4, int))[3:] > 0
            ratio, window, least = of_shapes * marked, limits.mark_window, limits.mark_ratio
        elif kind == "notice":
            ratio, window, least = model.letters[kind][bins[str(ORDERS[kind])]] + 0.5 * of_shapes, limits.window, limits.ratio
        else:
            ratio, window, least = model.letters[kind][bins[str(ORDERS[kind])]], limits.filler_window, limits.filler_ratio
        # A title may be shorter than a window; a short line of a body is no evidence by itself.
        room = np.minimum(window, np.maximum(np.repeat(sizes_all, sizes_all + 1), 3)) if title and kind == "notice" else window
        total = np.concatenate([[0], np.cumsum(_covered(ratio, stop, window, least, room) & solid)])
        out.covered[kind] = total[out.starts + out.sizes] - total[out.starts]
    return out


def judge(texts: list[str], model: Model, limits: Limits, title: bool) -> list[str | None]:
    """The kind of residue that makes each text residue, or None."""
    out: list[str | None] = [None] * len(texts)
    if not texts:
        return out
    lines = _lines(texts, model, limits, title)
    if not len(lines.starts):
        return out
    size = np.bincount(lines.text, weights=lines.sizes, minlength=len(texts))
    for kind, covered in lines.covered.items():
        share = np.bincount(lines.text, weights=covered, minlength=len(texts)) / np.maximum(size, 1)
        if kind == "placeholder":
            found = np.unique(lines.text[covered >= limits.mark_window])
        elif title:
            # One short word is too little to tell filler from a name.
            found = np.flatnonzero((share >= limits.title) & (size >= (limits.shortest_line / 2 if kind == "filler" else 1)))
        else:
            least = limits.shortest_filler if kind == "filler" else limits.shortest_line
            whole = lines.text[(lines.sizes >= least) & (covered >= limits.line * lines.sizes)]
            found = np.union1d(whole, np.flatnonzero(share >= limits.body))
        for i in found:
            out[i] = out[i] or kind
    return out


def count_lines(texts: list[str], model: Model, limits: Limits) -> dict[str, Counts]:
    """Gram counts of the lines that are almost wholly notices or filler."""
    lines = _lines(texts, model, limits, kinds=("notice", "filler"))
    out = {}
    for kind in ("notice", "filler"):
        pick = (lines.sizes >= limits.shortest_line) & (lines.covered[kind] >= limits.certain * lines.sizes)
        spans = [np.arange(a, a + n) for a, n in zip(lines.starts[pick], lines.sizes[pick], strict=True)]
        at = np.concatenate(spans) if spans else np.empty(0, np.int64)
        out[kind] = {k: np.bincount(b[at], minlength=BINS) for k, b in lines.bins.items()}
    return out


def _summed(counts: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """Counts ``(kind, gram, bin, n)`` of all partitions; at most kinds x 3 x BINS numbers."""
    out: dict[tuple[str, str], np.ndarray] = {}
    for r in counts.groupBy("kind", "gram", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        out.setdefault((r[0], r[1]), np.zeros(BINS))[r[2]] = r[3]
    return out


def _batched(batch: pd.DataFrame, columns: tuple[str, ...], size: int = 200) -> Iterator[list[str]]:
    for at in range(0, len(batch), size):
        for column in columns:
            if texts := [t for t in batch[column].iloc[at : at + size] if t]:
                yield texts


def _rows(kind: str, counts: Counts) -> Iterator[pd.DataFrame]:
    for gram, bins in counts.items():
        at = np.flatnonzero(bins)
        yield pd.DataFrame({"kind": kind, "gram": gram, "bin": at, "n": bins[at]})


_COUNT_SCHEMA = "kind string, gram string, bin int, n bigint"


def fit(df: DataFrame, title: str, body: str, limits: Limits = Limits()) -> Model:
    """Natural counts of all texts, then those of the lines a first model is certain about."""
    texts = df.select(F.col(title).alias("title"), F.col(body).alias("body"))

    def natural(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros(BINS, np.int64) for k in ("3", "4", "shape")}
        for batch in batches:
            for part in _batched(batch, ("title", "body")):
                for k, bins in grams("\n".join(part)).items():
                    total[k] += np.bincount(bins, minlength=BINS)
        yield from _rows("natural", total)

    counted = _summed(texts.mapInPandas(natural, _COUNT_SCHEMA))
    corpus = {k: counted.get(("natural", k), np.zeros(BINS)) for k in ("3", "4", "shape")}
    first = Model(corpus)

    def certain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counts] = {}
        for batch in batches:
            for part in _batched(batch, ("body",)):
                for kind, counts in count_lines(part, first, limits).items():
                    for k, bins in counts.items():
                        total.setdefault(kind, {}).setdefault(k, np.zeros(BINS, np.int64))
                        total[kind][k] += bins
        for kind, counts in total.items():
            yield from _rows(kind, counts)

    again = _summed(texts.mapInPandas(certain, _COUNT_SCHEMA))
    found = {kind: {k: again.get((kind, k), np.zeros(BINS)) for k in corpus} for kind in ("notice", "filler")}
    return Model(corpus, found)


def residue(df: DataFrame, key: str = "article_id", title: str = "title", body: str = "body", limits: Limits = Limits()) -> DataFrame:
    """``key, in_title, in_body`` of every row to exclude, with the kind of residue found in each field.

    A row goes if its title, one of its lines or half its body is a notice or
    filler, or if a placeholder stands anywhere. Null and empty fields are no
    residue. Keys may repeat; each row is judged by itself. Other columns are
    ignored, and an empty table gives an empty result. Prose is known from the
    table itself, so a table of a few hundred short texts is judged coarsely.
    """
    model = fit(df, title, body, limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                found = {c: judge([t or "" for t in part[c]], model, limits, c == "title") for c in ("title", "body")}
                out = pd.DataFrame({"key": part["key"].to_numpy(), "in_title": found["title"], "in_body": found["body"]})
                yield out[[bool(a or b) for a, b in zip(found["title"], found["body"], strict=True)]]

    rows = df.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(body).alias("body"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, in_title string, in_body string")
