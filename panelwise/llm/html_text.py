"""Main-text extraction (operator 7): tag ratios over a stream of parser events.

The standard library's parser reports tags and text; a page becomes a list of *lines*, one
for each block, with its characters, its tags and its open containers.  The text-to-tag ratio
of each line is smoothed with a Gaussian, and lines above a threshold (the ratios' standard
deviation) form the content cluster.  The innermost container that holds all of the cluster is
the article, and every line in it counts, so short paragraphs between long ones are not lost;
lines around it (a title, an intro) count too, unless most of their text is links.  Where
<article> or <main> elements hold at least half of the cluster's characters, the outermost ones
are the article, one after another.  Parts that are never article text (menus, page headers, footers, sidebars, notices, adverts,
scripts, styles, reader comments) are left out by tag, role, class or id.

Names may also sit on a wrapper of the page ("content-sidebar-wrap", a page-wide form), so boxes
left out by role, class, id or as a form are opened again where the ratio says that they hold the
article: where they hold the page's only articles, or where what stays outside of them has less
than a quarter of the characters of the cluster and of their own.

Null and empty pages, and pages without article text, give an empty text; repeated rows give
equal rows; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol
 optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul""".split())
NEVER = frozenset("""aside audio button canvas datalist dialog footer head iframe menu meter nav noscript
 object option progress script select style svg template textarea title video""".split())
FORMS = frozenset(("form", "fieldset"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
 status toolbar""".split())

#: Parts of class and id names that mark text around an article.
MARKS = frozenset("""ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment
 comments consent cookie cookies disclaimer disqus footer form gdpr login masthead menu menus modal nav navbar
 navigation newsletter notice notices notification overlay pagination paywall popup promo promos promotion related
 share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription teaser toc toolbar
 widget widgets""".split())
#: Words that say that a name tells of the page around, not of the box itself.
ABOUT = frozenset("has no with without".split())
#: A box is opened only if its own share of the cluster is at least so many characters.
LEAST = 200


class _Lines(HTMLParser):
    """Lines of a page: text, number of tags, open containers (ids of their start events), outermost
    first, and whether most of the text is links (never so in a heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, container number, left out
        self.articles: dict[int, bool] = {}  # container number, marked as something around an article
        self.boxes: set[int] = set()  # container numbers of boxes left out by name
        self.text: list[str] = []
        self.tags, self.made, self.out = 0, 0, 0
        self.in_link, self.linked = False, 0

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            links = 2 * self.linked > len(text) and not any(t in HEADINGS for t, _, _ in self.stack)
            self.lines.append((text, self.tags, tuple(c for _, c, _ in self.stack if c), links))
            self.tags = 0
        self.text, self.in_link, self.linked = [], False, 0

    def _marked(self, attrs) -> bool:
        for k, v in attrs:
            for name in (v or "").split() if k in ("class", "id") else ():
                words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
                if not MARKS.isdisjoint(words) and ABOUT.isdisjoint(words):
                    return True
        return False

    def _left_out(self, tag: str, attrs) -> bool:
        """Parts that are left out whatever they hold."""
        if tag in NEVER:
            return True
        if tag == "header":
            return not any(t in ARTICLE for t, _, _ in self.stack)
        return tag not in ("html", "body") and any(
            k == "hidden" or (v and k == "aria-hidden" and v.lower() == "true") for k, v in attrs)

    def _boxed(self, tag: str, attrs) -> bool:
        """Parts that are left out unless they hold the article."""
        if tag in FORMS:
            return True
        if tag in ("html", "body"):
            return False
        return (tag not in ARTICLE and self._marked(attrs)) or any(v and k == "role" and v.lower() in ROLES for k, v in attrs)

    def _pop_to(self, i: int) -> None:
        for _, _, out in self.stack[i:]:
            self.out -= out
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCK
        if block:
            self._line()
            for i in range(len(self.stack) - 1, -1, -1):  # a new block ends an open paragraph
                if self.stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        if tag == "a":
            self.in_link = any(k == "href" for k, _ in attrs)
        if tag in VOID:
            return
        out = self._left_out(tag, attrs)
        box = not out and self._boxed(tag, attrs)
        if block or out or box:
            number = 0
            if (block and tag != "p") or box:
                self.made += 1
                number = self.made
                if box:
                    self.boxes.add(number)
                if tag in ARTICLE or any(v and (k == "role" and v == "main" or k == "itemprop" and v == "articleBody") for k, v in attrs):
                    self.articles[number] = self._marked(attrs)
            self.stack.append((tag, number, out))
            self.out += out

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = False
        block = tag in BLOCK
        if block:
            self._line()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                break
            if not block and self.stack[i][0] in BLOCK:  # an inline end tag closes no block
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.out:
            self.text.append(data)
            if self.in_link:
                self.linked += len(" ".join(data.split()))


def smooth(x: np.ndarray, sigma: float = 1.0, reach: int = 2) -> np.ndarray:
    """Gaussian smoothing; the ends are padded with their own value."""
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), k / k.sum(), mode="valid")


def content_cluster(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are content: the smoothed ratio of characters to tags is at least its
    standard deviation, or the mean where the lines are alike."""
    ratio = smooth(chars / np.maximum(tags, 1))
    return ratio >= min(float(ratio.std()), float(ratio.mean()))


def visible_lines(p: _Lines) -> list:
    """The lines outside of all boxes, but for boxes that hold the article.  Tags of lines left out
    count with the next line that stays."""
    if not p.boxes or not p.lines:
        return p.lines
    chars = np.array([len(t) for t, _, _, _ in p.lines], np.float64)
    chars[~content_cluster(chars, np.array([n for _, n, _, _ in p.lines], np.float64))] = 0
    plain = {b for b, marked in p.articles.items() if not marked}
    closed = set(p.boxes)
    while True:
        shut = [tuple([b for b in inside if b in closed]) for _, _, inside, _ in p.lines]
        outside = sum(c for c, s in zip(chars, shut) if not s)
        own: dict[tuple, float] = {}  # by the closed boxes around a line
        holds = set()  # such boxes around an article
        for (_, _, inside, _), c, s in zip(p.lines, chars, shut):
            own[s] = own.get(s, 0.0) + c
            if not plain.isdisjoint(inside):
                holds.add(s)
        heavy = [s for s, w in own.items() if s and w >= LEAST and outside < 0.25 * (outside + w)]
        if holds and () not in holds:
            closed.difference_update(min(holds, key=lambda s: (len(s), -own[s], s)))
        elif heavy:  # few boxes before many: what lies deeper (comments in a wrapper) stays out
            closed.difference_update(min(heavy, key=lambda s: (len(s), -own[s], s)))
        else:
            break
    out, tags = [], 0
    for (text, n, inside, links), s in zip(p.lines, shut):
        tags += n
        if not s:
            out.append((text, tags, inside, links))
            tags = 0
    return out


def main_text(html: str) -> str:
    """The article text of a page; blocks joined by one space."""
    p = _Lines()
    p.feed(html)
    p.close()
    p._line()
    lines = visible_lines(p)
    if not lines:
        return ""
    chars = np.array([len(t) for t, _, _, _ in lines], np.float64)
    cluster = content_cluster(chars, np.array([n for _, n, _, _ in lines], np.float64))
    weight: dict[int, float] = {}
    for (_, _, inside, _), c, hit in zip(lines, chars, cluster):
        for box in inside if hit else ():
            weight[box] = weight.get(box, 0.0) + c
    total = float(chars[cluster].sum())
    named = [b for b in p.articles if b in weight]
    if named:  # the outermost articles; a marked one (comments, teasers) only where it is the heaviest
        best = max(named, key=lambda b: (weight[b], -b))
        plain = {b for b in named if b == best or not p.articles[b]}
        inner = [not plain.isdisjoint(inside) for _, _, inside, _ in lines]
        if chars[cluster & inner].sum() >= 0.5 * total:  # the cluster confirms them
            return " ".join(line[0] for line, i in zip(lines, inner) if i)
    core = max((b for b, w in weight.items() if w >= total), default=0)  # the innermost container of the whole cluster
    return " ".join(t for t, _, inside, links in lines if not core or core in inside or not links)


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                     F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def one(cols: dict) -> dict:
        text = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_arrow(rows, one, "page_id bigint, url string, text string, n_chars bigint")
