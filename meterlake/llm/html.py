"""Main text of web pages from parser events.

The standard library's parser streams start tags, end tags and text. Text inside page furniture
(menus, headers, footers, side bars, notices, adverts, forms, scripts, styles, reader comments; known
by tag, role, whole names in class or id, or names made of such words) is left out. A form that holds
all text of a page is no furniture. The rest becomes lines, one per block element. Each line has
its text-to-tag ratio; the ratios are smoothed by a Gaussian, and lines at or over the standard
deviation of the smoothed ratios are clustered as content. Each content line votes for its
region: the article it stands in (`article` or `main`; else its parent block). Regions with a vote are
kept, with all their lines, short ones too.

White space inside a line becomes one space; lines are joined by newlines. A page that breaks off
inside a tag loses that tag only. Declarations that html does not know are comments, a head ends where
body text begins, and end tags of nothing open are passed by.

Defined results: null or empty html gives an empty text, and so do pages without text. Repeated rows
are each reported. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.tasks import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("nav header footer aside form script style noscript template head title button select textarea iframe object svg canvas dialog menu search datalist audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs pager pagination comment comments commentlist disqus reply replies respond related recommended share sharing social newsletter subscribe signup login footer header masthead widget toolbar".split()
)
#: Words that furniture shares with running text: they count alone or beside other words of furniture or layout.
SHARED = frozenset("banner menu side related notice notices note alert promo respond reply replies comment share sharing social header subscribe recommended popup signup login widget".split())
LAYOUT = frozenset("area bar block body box button buttons column container content form group inner item items left link links list main meta module nav page panel post posts article articles region right row section site sub top bottom stories text title wrap wrapper".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title html head".split())
KEPT_WHOLE = frozenset(["html", "body", "article", "main"])
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main section div body html nav aside footer header form blockquote".split())
#: Scopes that are blocks of text, no regions.
LISTS = frozenset("ul ol dl table blockquote".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNENDED = re.compile(r"<(?:[a-zA-Z/][^<>]*|!(?:-(?:-(?:(?!-->)[\s\S])*)?)?)\Z")


def is_furniture(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in LEFT_OUT:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if tag in KEPT_WHOLE or not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and any(map(names_furniture, value.split())):
            return True
    return False


def names_furniture(name: str) -> bool:
    """Does a class or id name furniture: by a word of its own, or by a shared one among words of layout?"""
    words = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    if any(w in FURNITURE and w not in SHARED for w in words):
        return True
    return any(w in SHARED for w in words) and all(w in FURNITURE or w in LAYOUT for w in words)


class Lines(HTMLParser):
    """Collects (text, tags, region, in a form) per block from a page's events.

    What is open stands with how it is left out: 0 not, 1 as part of a form, 2 as other furniture.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: tag, number, how left out (itself or around it), place of the innermost open SCOPE, number of the innermost block of text blocks
        self.open: list[tuple[str, int, int, int, int]] = []
        self.opened: dict[str, list[int]] = {}  # places of the open ones of a tag
        self.articles: list[int] = []  # numbers of the open articles
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.count = 0

    def region(self) -> int:
        """The outermost article or main, else the innermost block that is no text block."""
        if self.articles:
            return self.articles[0]
        return self.open[-1][4] if self.open else 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, max(1, self.tags), self.region(), self.left_out() == 1))
            self.tags = 0
        self.text = []

    def left_out(self) -> int:
        return self.open[-1][2] if self.open else 0

    def close_to(self, at: int) -> None:
        if any(x[0] in BLOCK or x[2] for x in self.open[at:]):
            self.end_line()
        for tag, *_ in self.open[at:]:
            self.opened[tag].pop()
            if tag in ("article", "main"):
                self.articles.pop()
        del self.open[at:]

    def end_head(self) -> None:
        if self.opened.get("head"):
            self.close_to(self.opened["head"][0])

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in HEAD_TAGS:
            self.end_head()
        if tag in BLOCK or tag in VOID:
            # the outermost that this tag closes, within the innermost scope; no walk over what is open
            within = self.open[-1][3] if self.open else -1
            places = (self.opened.get(t) for t in CLOSES.get(tag, ("p",) if tag in BLOCK else ()))
            ends = [own[bisect_right(own, within)] for own in places if own and own[-1] > within]
            if ends:
                self.close_to(min(ends))
        out = before = self.left_out()
        if out == 1 and tag in ("article", "main"):
            out = 0
        if out < 2 and is_furniture(tag, attrs):
            out = 1 if tag == "form" else 2
        if tag in BLOCK or out != before:
            self.end_line()
        if tag in VOID:
            if tag == "br" and not out:
                self.text.append(" ")
            return
        self.count += 1
        _, _, _, scope, region = self.open[-1] if self.open else ("", 0, 0, -1, 0)
        self.opened.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            scope, region = len(self.open), region if tag in LISTS else self.count
        self.open.append((tag, self.count, out, scope, region))
        if tag in ("article", "main"):
            self.articles.append(self.count)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.opened.get(tag):
            self.close_to(self.opened[tag][-1])

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if self.left_out() < 2:
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[j], weights[j - i + reach]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(_UNENDED.sub("", html))
    parser.close()
    parser.end_line()
    lines = [x[:3] for x in parser.lines if not x[3]] or [x[:3] for x in parser.lines]
    if not lines:
        return ""
    ratios = smooth([len(text) / tags for text, tags, _ in lines], sigma)
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    kept = {region for (_, _, region), ratio in zip(lines, ratios, strict=True) if ratio >= threshold}
    return "\n".join(text for text, _, region in lines if region in kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """id, text for every row."""
    return map_texts(pages, id_col, html_col, lambda htmls: {"text": [main_text(h, sigma) for h in htmls]}, {"text": ("string", pa.string())})


def extract_with_url(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points); the url is carried beside the html, so no join is needed."""
    both = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return extract(both, "page", "html").select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))
