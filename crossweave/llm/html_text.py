"""Main text of web pages: flat text blocks, features of each and its neighbours, and a decision tree trained on a small labelled table.

A page is read once, front to back, into blocks: runs of text between block-level tags, with white space made one space and character references
decoded. Each block has its words, the share of them in links, whether it is a sentence, what it stands in, and words and link density of the blocks before and
after it. A decision tree, grown from the small table LABELLED below when the module is loaded, keeps or drops each block.

What an element is named is evidence of its place, and so is what it holds: names beside the article count unless they are negated ("no-sidebar",
"has-sidebar"), stand beside the article's own name, or are loose ones ("legal-text", "sharing", a form, a header) of an element that holds most of the page's
running text. An `article` may be named as something else ("ad", "comment") or hidden; articles inside another one are comments unless they hold most of the
running text together. Texts in scripts without spaces count two letters as a word.

Markup may be cut off or unclosed anywhere; what can't be a tag is text. Time is linear in a page's length. Null and empty pages have the text "". Equal
rows give equal rows. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAMING = frozenset("class id role aria-label itemprop".split())
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose content is no text of the page, up to their end tag; of the first ones up to the page's end where that is missing.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template svg object select button canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn msup msub mfrac".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav footer aside menu dialog".split())
LOOSE_AROUND = frozenset("form fieldset header".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure fieldset".split())
#: Parts of class and id names: of things that are never the article, and of things that may hold it.
AROUND_NAMES = frozenset(
    "ads advert adverts advertisement adbox adsense cookie cookies consent gdpr popup modal newsletter subscribe signup login nav navbar menu breadcrumb breadcrumbs "
    "sidebar comment comments commentlist disqus replies reply respond pagination pager taboola outbrain".split()
)
LOOSE_NAMES = frozenset(
    "ad sponsor sponsored promo promoted banner notice alert overlay aside footer header masthead topbar toolbar share sharing social related recommended recommendations more-posts widget "
    "copyright legal disclaimer skip tags hidden navigation responses".split()
)
LIST_NAMES = frozenset(["discussion"])  # of a list, that of readers; else it may be a section of the article
MAIN_NAMES = frozenset("article main content post story entry articlebody entry-content post-content article-body main-content".split())
NEGATED = frozenset("no non not without has with hide show".split())
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…:;。！？；：｡।؟។][\"')\]»”’」』）]*$")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")  # Thai, Lao, Burmese, Khmer, Japanese, Chinese
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
MOST = 0.5  # share of a page's words outside links, beyond which an element can't be beside the article by a loose name


@dataclass
class Block:
    text: str
    words: int
    linked: int
    around: bool  # in something beside the article
    main: bool  # in the article
    heading: bool
    loose: int = 0  # the innermost element around it that is beside the article unless it holds most of the page

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def count_words(text: str) -> int:
    """Words between white space; two letters of a script without spaces are one."""
    n = len(text.split())
    return n if text.isascii() else n + sum(len(run) // 2 for run in _UNSPACED.findall(text))


def _names(attrs: str, tag: str = "") -> tuple[bool, bool, bool, bool]:
    """Whether the attributes surely or loosely name something beside the article, name the article, or hide the element."""
    around = loose = alone = main = article = hidden = False
    loose_names = LOOSE_NAMES | LIST_NAMES if tag in ("ul", "ol") else LOOSE_NAMES
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"' ")
        if name in _NAMING:
            for whole in _CAMEL.sub("-", value).lower().replace("_", "-").split():
                parts = whole.split("-")
                own = {x for i, x in enumerate(parts) if not (i and parts[i - 1] in NEGATED)}
                article |= whole in MAIN_NAMES
                main |= whole in MAIN_NAMES or bool(own & MAIN_NAMES)
                around |= whole in AROUND_NAMES
                alone |= whole in loose_names and whole not in _UNSURE
                loose |= bool(own & (AROUND_NAMES | loose_names))
        else:
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or bool(name == "style" and _NOT_SHOWN.search(value))
    # a part of a compound name ("has-sidebar") says nothing of an element with an article's name
    return around or hidden, alone or (loose and not article), main, hidden


#: Loose names that say little of an element with an article's name, even where they are a whole name.
_UNSURE = frozenset(["header", "tags", "notice", "legal", "overlay"])


class _Tags:
    """The tags of a page, found in one pass: (start, end, closing, name, attributes); name is empty for comments and the like."""

    def __init__(self, html: str):
        self.html, self.n = html, len(html)
        self.last = {q: html.rfind(q) for q in "\"'>"}
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose attributes start at `at`; the page's end if there is none. A quote that nothing closes is a letter."""
        while True:
            at = _PLAIN.match(self.html, at).end()
            if at >= self.n or self.html[at] == ">":
                return at
            close = self.html.find(self.html[at], at + 1) if at < self.last[self.html[at]] else -1
            at = close + 1 if close >= 0 else at + 1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        html, at = self.html, 0
        while (at := html.find("<", at)) >= 0:
            for mark, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(mark, at):
                    end = html.find(stop, at + len(mark))
                    end = self.n if end < 0 else end + len(stop)
                    break
            else:
                closing = html.startswith("/", at + 1)
                m = _NAME.match(html, at + 1 + closing)
                if m:
                    name, stop = m[0].lower(), self._end(m.end())
                    end = min(self.n, stop + 1)
                    if not closing and name in SKIPPED:
                        end, name = self._skip(name, end)
                    yield at, end, closing, name, html[m.end() : stop] if name else ""
                    at = end
                    continue
                if not html.startswith(("!", "?", "/"), at + 1):
                    at += 1
                    continue
                end = html.find(">", at) + 1 or self.n
            yield at, end, False, "", ""
            at = end

    def _skip(self, name: str, at: int) -> tuple[int, str]:
        """Where the element that opened before `at` ends, with no name, as it has no text; or `at` and its name, if nothing closes it."""
        if name not in self.unclosed:
            if m := re.compile(rf"</{name}\b[^>]*>?", re.I).search(self.html, at):
                return m.end(), ""
            self.unclosed.add(name)
        return (self.n, "") if name in RAW else (at, name)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]  # name, around, main, innermost loose element, outermost article
    outside = [0]  # of each loose element, the loose one around it, a smaller number
    inner: dict[tuple[int, int], int] = {}  # articles inside another one, which are a loose element together, by that and what is around them
    places: dict[str, list[int]] = {}  # in the stack, by name
    outer = [0]  # places of the elements that are not inline
    parts: list[str] = []
    linked: list[str] = []
    links = articles = 0

    def end() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                n = count_words(text)
                _, around, main, loose, _ = stack[-1]
                out.append(Block(text, n, min(n, count_words(unescape(" ".join(linked)))), around, main, any(len(s[0]) == 2 and s[0][0] == "h" and s[0][1].isdigit() for s in stack[-3:]), loose))
        parts.clear()
        linked.clear()

    def pop(to: int) -> None:
        nonlocal links
        for s in reversed(stack[to:]):
            links -= s[0] == "a"
            places[s[0]].pop()
        del stack[to:]
        while outer[-1] >= to:
            outer.pop()

    at = 0
    for start, stop, closing, name, attrs in _Tags(html):
        if start > at:
            parts.append(html[at:start])
            if links:
                linked.append(html[at:start])
        at = stop
        if not name or name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end()
        if closing:
            k = places[name][-1] if places.get(name) else 0
            if k and (name not in INLINE or outer[-1] < k):
                pop(k)
            continue
        if name in CLOSES_P or name == "li":
            k = outer[-1]
            if k and stack[k][0] == ("li" if name == "li" else "p"):
                pop(k)
        if name in VOID:
            continue
        around, loose, main, hidden = _names(attrs, name) if attrs.strip() else (False, False, False, False)
        _, was_around, was_main, was_loose, article = stack[-1]
        if name in ("body", "html"):
            now = (name, was_around, was_main, was_loose, article)
        elif name in MAIN:
            around = hidden or (around or loose) and not main
            within = was_loose
            if name == "article" and article:
                if (article, was_loose) not in inner:
                    inner[article, was_loose] = len(outside)
                    outside.append(was_loose)
                within = inner[article, was_loose]
            elif name == "article":
                articles += 1
                article = articles
            now = (name, was_around or around, was_main or not around, within, article)
        else:
            # a header of the article itself is part of it
            around |= name in AROUND
            loose |= name in LOOSE_AROUND and not (name == "header" and was_main)
            within = was_loose
            if loose:
                within = len(outside)
                outside.append(was_loose)
            now = (name, was_around or around, was_main or (main and not around), within, article)
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
        stack.append(now)
        links += name == "a"
    if at < len(html):
        parts.append(html[at:])
    end()
    own, marked = [0] * len(outside), [0] * len(outside)  # running words of each loose element, and blocks marked as the article
    for b in out:
        own[b.loose] += b.words - b.linked
        marked[b.loose] += b.main and not b.around
    for e in range(len(outside) - 1, 0, -1):
        own[outside[e]] += own[e]
        marked[outside[e]] += marked[e]
    most, together = MOST * sum(b.words - b.linked for b in out if not b.around), set(inner.values())
    beside = [False] * len(outside)
    for e in range(1, len(outside)):  # what holds most of the page, and all that is marked as the article, is not beside it
        beside[e] = beside[outside[e]] or own[e] <= most or (e not in together and marked[e] < marked[0])
    for b in out:
        b.around |= beside[b.loose]
    return out


FEATURES = ("around", "main", "page_has_main", "words", "density", "heading", "sentence", "words_before", "density_before", "words_after", "density_after")

#: Labelled neighbourhoods: words and link density of the block before and of the one after.
NEAR = ((0, 0.0, 60, 0.0), (1, 1.0, 9, 0.0), (40, 0.0, 30, 0.0), (12, 0.0, 1, 1.0), (90, 0.05, 0, 0.0), (2, 0.0, 14, 0.9), (1, 1.0, 2, 1.0), (300, 0.0, 200, 0.0))
#: Labelled blocks of pages that mark their article, or what is beside it: whether a block is in something beside the article, in the article, whether the page marks its
#: article, words, link density, heading; the label (1: of the article). The marks decide, beside any neighbours, sentence or not.
MARKED = (
    ((0, 1, 1, 40, 0.0, 0), 1), ((0, 1, 1, 1, 0.0, 0), 1), ((0, 1, 1, 9, 0.0, 1), 1), ((0, 1, 1, 25, 0.3, 0), 1), ((0, 1, 1, 6, 1.0, 0), 1), ((0, 1, 1, 300, 0.02, 0), 1),
    ((1, 0, 1, 1, 1.0, 0), 0), ((1, 0, 1, 30, 0.0, 0), 0), ((1, 0, 1, 120, 0.0, 0), 0), ((1, 1, 1, 40, 0.0, 0), 0), ((1, 1, 1, 5, 0.6, 0), 0), ((1, 1, 1, 4, 0.0, 1), 0),
    ((0, 0, 1, 11, 0.0, 0), 0), ((0, 0, 1, 60, 0.0, 0), 0), ((0, 0, 1, 2, 1.0, 0), 0), ((0, 0, 1, 5, 0.0, 1), 0), ((1, 0, 0, 35, 0.0, 0), 0), ((1, 0, 0, 4, 0.9, 0), 0), ((1, 0, 0, 200, 0.0, 0), 0),
)
#: Labelled blocks of pages that don't mark their article: the same numbers, whether the block ends as a sentence does, its neighbourhood, the label.
UNMARKED = (
    # running text, also short, beside running text
    ((0, 0, 0, 45, 0.0, 0, 1, 8, 0.0, 50, 0.0), 1), ((0, 0, 0, 33, 0.1, 0, 1, 41, 0.0, 2, 1.0), 1), ((0, 0, 0, 90, 0.05, 0, 1, 1, 1.0, 70, 0.0), 1), ((0, 0, 0, 20, 0.0, 0, 1, 3, 1.0, 35, 0.0), 1),
    ((0, 0, 0, 8, 0.0, 1, 0, 2, 1.0, 40, 0.0), 1), ((0, 0, 0, 6, 0.0, 0, 1, 40, 0.0, 38, 0.0), 1), ((0, 0, 0, 48, 0.0, 0, 1, 1, 1.0, 1, 1.0), 1), ((0, 0, 0, 120, 0.0, 0, 1, 0, 0.0, 0, 0.0), 1),
    ((0, 0, 0, 17, 0.0, 0, 1, 60, 0.0, 2, 1.0), 1), ((0, 0, 0, 2, 0.0, 0, 1, 70, 0.0, 25, 0.0), 1), ((0, 0, 0, 1, 0.0, 0, 1, 2, 0.0, 9, 0.0), 1), ((0, 0, 0, 2, 0.0, 0, 1, 1, 0.0, 30, 0.0), 1),
    ((0, 0, 0, 3, 0.0, 0, 1, 25, 0.0, 2, 0.0), 1), ((0, 0, 0, 60, 0.2, 0, 1, 2, 1.0, 2, 1.0), 1), ((0, 0, 0, 25, 0.0, 0, 0, 0, 0.0, 90, 0.0), 1), ((0, 0, 0, 4, 0.0, 1, 0, 70, 0.0, 60, 0.0), 1),
    ((0, 0, 0, 3, 0.0, 0, 0, 45, 0.0, 50, 0.0), 1), ((0, 0, 0, 12, 0.0, 0, 1, 4, 0.0, 3, 0.0), 1), ((0, 0, 0, 5, 0.0, 0, 1, 0, 0.0, 0, 0.0), 1), ((0, 0, 0, 2, 0.0, 0, 1, 12, 0.0, 0, 0.0), 1),
    # and what stands there beside links
    ((0, 0, 0, 3, 1.0, 0, 0, 2, 1.0, 3, 1.0), 0), ((0, 0, 0, 10, 0.8, 0, 0, 9, 0.7, 12, 0.9), 0), ((0, 0, 0, 4, 0.0, 0, 0, 2, 1.0, 0, 0.0), 0), ((0, 0, 0, 5, 0.0, 0, 0, 2, 0.0, 3, 1.0), 0),
    ((0, 0, 0, 16, 0.7, 0, 0, 30, 0.0, 2, 1.0), 0), ((0, 0, 0, 2, 0.0, 0, 0, 1, 1.0, 1, 1.0), 0), ((0, 0, 0, 40, 0.9, 0, 0, 3, 0.0, 50, 0.0), 0), ((0, 0, 0, 1, 1.0, 0, 0, 48, 0.0, 0, 0.0), 0),
    ((0, 0, 0, 3, 0.6, 0, 0, 48, 0.0, 0, 0.0), 0), ((0, 0, 0, 2, 1.0, 0, 0, 0, 0.0, 48, 0.0), 0), ((0, 0, 0, 9, 1.0, 0, 0, 80, 0.0, 80, 0.0), 0), ((0, 0, 0, 4, 0.0, 0, 0, 1, 1.0, 6, 0.0), 0),
    ((0, 0, 0, 4, 0.0, 0, 1, 3, 1.0, 2, 1.0), 0), ((0, 0, 0, 6, 0.0, 0, 0, 50, 0.0, 2, 1.0), 0), ((0, 0, 0, 3, 0.0, 1, 0, 30, 0.0, 2, 1.0), 0), ((0, 0, 0, 3, 0.0, 0, 1, 2, 1.0, 0, 0.0), 0),
    ((0, 0, 0, 5, 0.0, 0, 0, 4, 0.0, 0, 0.0), 0), ((0, 0, 0, 90, 0.0, 0, 1, 120, 0.0, 80, 0.0), 1), ((0, 0, 0, 150, 0.02, 0, 1, 200, 0.0, 2, 1.0), 1), ((0, 0, 0, 7, 0.0, 0, 1, 110, 0.0, 95, 0.0), 1),
    ((0, 0, 0, 10, 0.0, 0, 1, 6, 1.0, 40, 0.0), 1), ((0, 0, 0, 9, 0.0, 0, 1, 30, 1.0, 15, 0.0), 1), ((0, 0, 0, 5, 0.0, 0, 1, 3, 1.0, 22, 0.0), 1),
    # long text without an end mark
    ((0, 0, 0, 30, 0.0, 0, 0, 0, 0.0, 6, 0.0), 1), ((0, 0, 0, 40, 0.0, 0, 0, 2, 1.0, 3, 1.0), 1), ((0, 0, 0, 70, 0.1, 0, 0, 30, 0.0, 0, 0.0), 1), ((0, 0, 0, 35, 0.0, 0, 0, 3, 1.0, 12, 0.0), 1),
    ((0, 0, 0, 14, 0.0, 0, 0, 2, 1.0, 2, 1.0), 0), ((0, 0, 0, 11, 0.0, 0, 0, 40, 0.0, 3, 1.0), 0),
)
LABELLED = tuple(((*x, sentence, *near), y) for x, y in MARKED for near in NEAR for sentence in (0, 1)) + UNMARKED


def grow(rows: tuple, depth: int = 12) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above it) or a label."""
    ones = sum(label for _, label in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(some: list) -> float:
        p = sum(label for _, label in some) / len(some)
        return 2 * p * (1 - p) * len(some)

    best = None
    for k in range(len(FEATURES)):
        values = sorted({x[k] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[0][k] <= cut], [r for r in rows if r[0][k] > cut]
            found = (impurity(low) + impurity(high), k, cut, tuple(low), tuple(high))
            best = min(best, found, key=lambda f: f[:3]) if best else found
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


TREE = grow(LABELLED)


def classify(features: tuple, tree: tuple | int = TREE) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_blocks(found: list[Block], tree: tuple | int = TREE) -> list[Block]:
    none = Block("", 0, 0, False, False, False)
    has = any(b.main and not b.around for b in found)
    out = []
    for p, b, n in zip([none, *found], found, [*found[1:], none], strict=False):
        x = (int(b.around), int(b.main), int(has), b.words, b.density, int(b.heading), int(bool(_SENTENCE.search(b.text))), p.words, p.density, n.words, n.density)
        if classify(x, tree):
            out.append(b)
    return out


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(blocks(html or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLE_SQL: dict[str, str] = {}
