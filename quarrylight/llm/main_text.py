"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page. A line's weight is its text length without link
text, and 0 in boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments). Weights
are summed over windows of `WINDOW` lines. Text begins where the sum surges over the threshold and ends
where it dives to nothing, and takes in adjoining lines with weight; the lines between are kept unless they
are boilerplate, links as well. The threshold is a share of the highest sum or of a window of median lines,
whichever is less. Where a page names its article (`article`, `main` or the role `main`), all lines in it
that are not boilerplate are kept, and none outside it.

Nulls: a null page is empty and gives an empty text. A page without any line gives an empty text.
Unclosed elements end with the block that holds them. Empty tables give empty results, repeated rows one
result each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import text_of

WINDOW = 3
THRESHOLD_SHARE = 0.25
# Elements by what they mean for the text. Fixed values of HTML.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea option button datalist head title".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p li dt dd td th tr option".split())
# Words in class, id or role that mark boilerplate. Fixed values.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side widget footer header masthead topbar comment comments respond disqus reply replies "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social "
    "related recommended recommendations teaser teasers pagination pager toolbar copyright legal disclaimer complementary contentinfo "
    "hidden form".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^<>]*>",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
# Parts of names of the whole layout ("content-with-sidebar", "layout-sidebar-right", "two-column").
LAYOUT_WORDS = frozenset("has no with without layout wrapper wrap container content main page body grid row column columns col".split())
PARTS = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    text: str
    weight: int
    named: bool  # inside an element that names the article
    aside: bool  # in boilerplate


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag, names and values in small letters; the first of a name counts."""
    found: dict[str, str] = {}
    start = NAME.match(tag)
    for m in ATTRIBUTE.finditer(tag, start.end() if start else 0):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def marks_boilerplate(name: str, tag: str) -> bool:
    values = attributes(tag)
    if "hidden" in values or values.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    for key in ("class", "id", "role"):
        for token in values.get(key, "").split():
            parts = PARTS.findall(token)
            if not LAYOUT_WORDS.intersection(parts) and ASIDE_WORDS.intersection(parts):
                return True
    return False


def names_article(name: str, tag: str) -> bool:
    return name in ("article", "main") or attributes(tag).get("role") == "main"


def page_lines(page: str) -> list[Line]:
    """The page's blocks of text, in order."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, boilerplate, names the article
    text: list[str] = []
    linked = aside = named = links = 0

    def close_line() -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            weight = 0 if aside else max(len(words) - linked, 0 if linked else len(words))
            lines.append(Line(words, weight, named > 0, aside > 0))
        text.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal aside, named
        while len(stack) > depth:
            _, was_aside, was_named = stack.pop()
            aside -= was_aside
            named -= was_named

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(" ".join(html.unescape(piece).split()))

    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = found[0]
        if found[1] or tag.startswith(("<!", "<?")):
            continue
        name = NAME.match(tag)
        if not name:
            continue
        name = name[1].lower()
        if name == "a":
            links = 0 if tag[1] == "/" else 1
            continue
        if name in INLINE and not (tag[1] != "/" and marks_boilerplate(name, tag)) and not any(n == name for n, _, _ in stack):
            if name == "br":
                text.append(" ")
            continue
        close_line()
        links = 0
        if tag[1] == "/":
            places = [i for i, (n, _, _) in enumerate(stack) if n == name]
            if places:
                leave(places[-1])
            continue
        if name in VOID:
            continue
        if name == "body":
            leave(0)
        while stack and stack[-1][0] in PARAGRAPHS and name not in INLINE and (stack[-1][0] == "p" or stack[-1][0] == name):
            leave(len(stack) - 1)
        is_named = names_article(name, tag)
        noted = marks_boilerplate(name, tag)
        if is_named and not noted and named == 0:
            # An article ends boilerplate that was never closed.
            kept = [i for i, (_, was_aside, _) in enumerate(stack) if was_aside]
            if kept:
                leave(kept[0])
        inside = named > 0 and name == "header"
        is_aside = (name in ASIDE or name in SILENT or noted) and not inside
        stack.append((name, is_aside, is_named and not is_aside))
        aside += is_aside
        named += is_named and not is_aside
        if tag.endswith("/>") and name not in ("p", "div", "article", "section"):
            leave(len(stack) - 1)
    if at < len(page):
        rest = page[at:]
        # A tag that the page's end cuts off is markup, not text.
        cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)
        add(rest[: cut.start()] if cut else rest)
    close_line()
    return lines


def main_lines(lines: list[Line]) -> list[str]:
    """The lines between surge and dive points of the windowed weights."""
    has_name = any(line.named and line.weight for line in lines)
    if has_name:
        # The page says where its text is: all of it, links as well.
        return [line.text for line in lines if line.named and not line.aside]
    weights = [line.weight for line in lines]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    threshold = THRESHOLD_SHARE * min(max(sums, default=0), WINDOW * median([w for w in weights if w] or [0]))
    inside, spans = False, []
    for i in range(len(lines)):
        if not inside and sums[i] > threshold and weights[i]:
            inside = True
            spans.append([i, i])
        elif inside and not sums[i]:
            inside = False
        if inside and weights[i]:
            spans[-1][1] = i
    # Spans grow over adjoining lines with weight; what lies in a span stays unless it is boilerplate.
    kept = set()
    for low, high in spans:
        while low and weights[low - 1]:
            low -= 1
        while high + 1 < len(lines) and weights[high + 1]:
            high += 1
        kept.update(i for i in range(low, high + 1) if not lines[i].aside)
    return [lines[i].text for i in sorted(kept)]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(page_lines(page or "")))


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: id, url, text (blocks joined by an empty line), n_chars. One pass, no shuffle."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("page").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    source = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), text_of(html_column).alias("page")
    )
    found = source.mapInArrow(extract, "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
