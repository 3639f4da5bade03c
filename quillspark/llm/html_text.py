"""HTML extraction by line-block distribution.

The page is cut into lines at its block-level elements, markup stripped. A
line in a menu, header, footer, sidebar, notice, advert, form, script, style
or comment section counts 0 characters, as does one that is mostly link text
and, where the page marks its articles (`article` or `main`), one outside of
them; every other line counts its characters. Sums over a window that slides
along the lines give the block distribution: the text surges where a window
first reaches the threshold and dives where the windows fall below it again.
The threshold is THRESHOLD characters, or the greatest window on a page whose
windows are all below it.

The surges say where the main text is. Where a surge is in a marked article,
that article is main text, its short lines before the last dive too; after it, where
the windows have fallen for good, only lines that say something stay, and the
labels and headings at the very end (share, tags, more) go. On a page without a marked article,
main text are the lines from the first surge to the last dive that aren't
mostly link text, less menu-like ones at either end, and the headings right
above the first surge. Left-out elements are never part of it, unless only one word
of a class beside others says so and the element holds most of the page's text.

Character references are decoded, white space inside a line is one space,
empty lines go, and lines are joined by a line feed in page order. A line
break (`br`) is white space. Tags are read in one pass: what follows a `<`
that opens no whole tag is text.

Defined cases: null or empty html, and pages without text, give an empty
text and 0 characters; unclosed elements end with the page, except that an
article ends a left-out element that was never closed, unless that holds
comments or stands in an article itself; malformed tags are text; very long
pages are one pass; repeated rows are extracted each for itself; of surges
alike none is preferred, all count; an empty table gives an empty result; a
null id or url stays null; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import common

WINDOW = 3
THRESHOLD = 86
#: Element and attribute names of HTML, and usual class words.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
LEFT_OUT = frozenset("nav footer aside form button select menu dialog head search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist commentary disqus respond reply replies".split())
#: Words that decide by themselves, whatever stands beside them; not if the first one denies or states a feature.
STRONG = COMMENTS - {"respond", "reply", "replies", "commentary"} | frozenset("ads advert adverts advertisement advertisements advertising sponsored cookie cookies gdpr".split())
FEATURES = frozenset("has have no not with without hide hides show shows open closed allow allows enable enabled disable disabled js is".split())
WORDS = COMMENTS | frozenset("alert alerts ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup social share sharing related recommended widget toolbar pagination pager login masthead".split())
#: Words that say where such a part is or what form it has: `site-footer` is one, `side-effects` isn't.
FORMS = frozenset("site page global main top bottom left right primary secondary header post posts article articles entry content list lists item items links link bar box block section container wrapper wrap area slot unit inner outer form buttons button icons text title policy media stories reading news story thread feed info warning success danger error message messages dialog user reader google discussion".split())
KEPT = frozenset("html body article main".split())

#: A quote counts after an equals sign only; possessive throughout, so that a tag is read once or not at all.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""", re.DOTALL)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""", re.IGNORECASE)
MARK = re.compile(r"<(?:article|main)(?![\w-])", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])[^<>]*+>?", re.IGNORECASE) for t in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def said(value: str, words: frozenset, decisive: frozenset = frozenset()) -> bool:
    """Whether a class or id names one of the words: as a whole, together
    with words of form only, or, for a decisive one, with any words."""
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if any(x in words for x in parts) and all(x in WORDS or x in FORMS or x.isdigit() for x in parts):
            return True
        if parts and parts[0] not in FEATURES and any(x in words and x in decisive for x in parts):
            return True
    return False


def left_out(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is left out: "comments", "other", "word" if only a
    decisive word among others says so, or nothing."""
    if tag in ("html", "body"):
        return ""
    why = "other" if tag in LEFT_OUT or (tag == "header" and not in_article) else ""
    if attributes and "=" in attributes or "hidden" in attributes.lower():
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id") and said(value, COMMENTS):
                return "comments"
            if tag not in KEPT and (name == "hidden" or (name == "role" and value in ROLES) or (name in ("class", "id") and said(value, WORDS))):
                why = "other"
            if not why and tag not in KEPT and name in ("class", "id") and said(value, STRONG, STRONG):
                why = "word"
    return why


class Line(NamedTuple):
    text: str
    links: int  # characters of link text
    counted: bool  # not in a left-out element
    article: int  # number of the outermost article it is in; 0 for none
    heading: bool
    word: int  # number of the element that a decisive word leaves out; 0 for none


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    parts: list[str] = []
    links = depth = articles = 0  # characters of links in this line; open articles, and all so far
    anchor = heading = False
    shut: list[str] = []  # open elements of the left-out one's name; its first entry is that one
    firm = False  # an article doesn't end the left-out element
    words = word = 0  # elements left out by a decisive word so far, and the open one
    at, n = 0, len(page)

    def text(to: int) -> None:
        nonlocal links
        if to > at:
            s = html.unescape(page[at:to])
            parts.append(s)
            if anchor:
                links += len(s.strip())

    def line() -> None:
        nonlocal links
        if parts:
            s = " ".join("".join(parts).split())
            parts.clear()
            if s:
                lines.append(Line(s, links, not shut, articles if depth else 0, heading, word if shut else 0))
        links = 0

    while m := TAG.search(page, at):
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if not closing and tag in RAW and not m[3].endswith("/"):
            line() if tag in BLOCKS else None
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchor = not closing
        if tag in BLOCKS:
            line()
            heading = tag in HEADINGS and not closing
        why = "" if closing or tag in VOID else left_out(tag, m[3], depth > 0)
        marks = tag in ("article", "main")
        if marks and not closing and not why and not firm:
            shut.clear()
        if shut:
            if tag == shut[0] and tag not in VOID:
                shut.pop() if closing else shut.append(tag)
        elif why:
            line()
            shut.append(tag)
            firm = why != "other" or depth > 0
            words += why == "word"
            word = words if why == "word" else 0
        firm = firm and bool(shut)
        if marks:
            articles += not closing and not depth
            depth = max(0, depth + (-1 if closing else 1))
    text(n)
    line()
    return lines


def surges(sizes: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch of windows that reach the threshold."""
    n, windows, running = len(sizes), [], sum(sizes[:window])
    for i in range(n):
        windows.append(running)
        running += (sizes[i + window] if i + window < n else 0) - sizes[i]
    threshold = max(1, min(threshold, max(windows, default=0)))
    spans, i = [], 0
    while i < n:
        if windows[i] < threshold:
            i += 1
            continue
        surge = i
        while i < n and windows[i] >= threshold:
            i += 1
        dive = min(n, i - 1 + window)
        while not sizes[surge]:  # a window reaches ahead to its text
            surge += 1
        while not sizes[dive - 1]:
            dive -= 1
        spans.append((surge, dive))
    return spans


def _label(line: str) -> bool:
    """Too short for text and no sentence: what a menu entry looks like."""
    return len(line) < 20 and line[-1] not in ".!?:;\u3002\uff01\uff1f"


def weighed(lines: list[Line]) -> list[Line]:
    """An element that a decisive word leaves out but that holds most of the
    page's text is the page's text."""
    size: dict[int, int] = {}
    for x in lines:
        if x.counted or x.word:
            size[x.word] = size.get(x.word, 0) + len(x.text)
    total = sum(size.values())
    most = {w for w, n in size.items() if w and 2 * n > total}
    return [x._replace(counted=True) if x.word in most else x for x in lines] if most else lines


def cut_tail(lines: list[Line], spans: list[tuple[int, int]], article: int) -> int:
    """Where an article ends: after its last dive only what says something
    stays, not the labels and headings without text that come at its end."""
    held = [i for i, x in enumerate(lines) if x.article == article and x.counted]
    dive = max((b for a, b in spans if any(lines[i].article == article for i in range(a, b))), default=0)
    while held and held[-1] >= dive and (lines[held[-1]].heading or _label(lines[held[-1]].text)):
        held.pop()
    return held[-1] + 1 if held else 0


def main_text(page: str | None) -> str:
    page = page or ""
    lines = weighed(lines_of(page))
    marked = MARK.search(page) is not None and any(x.article and x.counted for x in lines)
    sizes = [len(x.text) if x.counted and (x.links * 2 <= len(x.text)) and (x.article or not marked) else 0 for x in lines]
    spans = surges(sizes)
    if marked:
        main = {lines[i].article for a, b in spans for i in range(a, b) if sizes[i]}
        if not spans:  # an article of links only
            main = {x.article for x in lines if x.article and x.counted}
        ends = {a: cut_tail(lines, spans, a) if spans else len(lines) for a in main}
        return "\n".join(x.text for i, x in enumerate(lines) if x.counted and x.article in main and x.article and i < ends[x.article])
    if not spans:
        return ""
    a, b = spans[0][0], spans[-1][1]
    while a < b and _label(lines[a].text) and not lines[a].heading:
        a += 1
    while a < b and _label(lines[b - 1].text):
        b -= 1
    while a and lines[a - 1].heading and lines[a - 1].counted:
        a -= 1
    return "\n".join(lines[i].text for i in range(a, b) if sizes[i])


def _row(page: str | None) -> tuple[str, int]:
    out = main_text(page)
    return out, len(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    both = pages.selectExpr(f"named_struct('k', `{key}`, 'u', `{url}`) AS both", f"`{body}` AS html")
    out = common.per_text(both, _row, ["text", "n_chars"], "text string, n_chars long", "both", "html")
    return out.selectExpr(f"both.k AS `{key}`", f"both.u AS `{url}`", "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
