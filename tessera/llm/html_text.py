"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of block elements (tags with their class names) from the root.
For every distinct path the text length and the punctuation of its blocks are added up and divided by their number;
text inside links lies on the links' own paths and counts for nothing here, except in headings. Both ratios are smoothed over the
page's blocks (seven taps), a path taking the geometric mean of its own ratio and the smoothed one, and are fused by their
geometric mean, on a logarithmic scale. A path's score is weighed by what its elements say: an article or main element
speaks for it, and navigation, page headers and footers, asides, forms, and class, id and role names of adverts,
notices, comments and the like speak against it. A page without article and main has its heaviest container, found by
going down while one child holds nearly all of the scored text, and what lies outside it is weighed down. Paths whose weighed score reaches a share of
the page's level (the mean of the scores, weighed by text and score) are content, and the blocks on them are
returned in page order, whole.

Defined results: a null or empty page, and one with nothing but links and marked elements, has an empty text; unclosed
and crossing tags are closed where their parents end; unclosed comments, scripts, styles and tags run to the end of the page; character
references are decoded once; pages are read whole, in linear time for any input; blocks on one path (and on one side of the
container's border) are chosen or left together, so ties need no order; repeated rows get equal results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_slices, pick

#: The elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What lies in these is not markup, and not text of the page either.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
#: Elements whose text is not read.
UNREAD = frozenset("template svg math object select button audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold a whole article.
CONTAINERS = frozenset("body div section center table tbody tr td".split())
#: An element that opens here ends an open one of these, unless one of the scope's opened since.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
P_SCOPE = ("td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "aside", "footer", "header", "dd", "button")
KEEPS_P = frozenset("li td th tr dd dt html body head".split())

#: Weights of what speaks for and against a path.
AGAINST = {**dict.fromkeys("nav footer aside menu dialog head".split(), 0.01), "form": 0.05, "fieldset": 0.05}
NAMED = 0.01
LEVELS = (1.0, 30.0, 120.0)  # nothing, main, article
OUTSIDE = 1 / 8  # of the container
HEADING = 2.0
#: Words of class, id and role names that mark what is not the article ...
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments commentlist reply replies disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations teaser widget pagination pager copyright legal disclaimer toolbar topbar search complementary contentinfo dialog".split()
)
#: Fixed values: ... and words that may stand beside them in one name without changing what it says.
NEUTRAL = frozenset(
    "a area articles bar block body bottom box button buttons container content form group head holder inner item items left lg link links list main md medium middle mini mobile new outer page panel "
    "post posts primary reader readers right row section secondary site slot sm small stories sub text the thread title top unit user users view wrap wrapper".split()
)
TAPS = np.exp(-(np.arange(-3, 4) ** 2) / 2.0)

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the tag's end: quoted values may hold its sign.
ATTRIBUTES = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


def speaks_against(names: str, inside: bool = False) -> bool:
    """Whether one of the names is made of marking words (and neutral ones) alone: "cookie-notice" is, "legal-history" isn't.

    inside: an article has a header of its own, which belongs to it.
    """
    for name in names.split():
        parts = [x.lower() for x in WORD_PARTS.findall(name)]
        if inside and ("header" in parts or "masthead" in parts):
            continue
        if any(x in BOILERPLATE for x in parts) and all(x in BOILERPLATE or x in NEUTRAL or x.isdigit() for x in parts):
            return True
    return False


class Page:
    """A page's elements (parents before children) and text blocks."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path = [-1], [""], [0]
        #: each distinct path's weight against it and level for it
        self.paths: dict[tuple, int] = {(-1, "", 1.0, 0): 0}
        self.weight: list[tuple[float, int]] = [(1.0, 0)]
        self.texts: list[str] = []
        self.element: list[int] = []
        self.chars: list[int] = []
        self.signs: list[int] = []
        self._read(source)

    def _new(self, tag: str, attributes: str, parent: int) -> int:
        against, level = self.weight[self.path[parent]]
        classes = ""
        if "=" in attributes:
            found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAMES.finditer(attributes)]
            classes = " ".join(v for k, v in found if k == "class")
            if tag != "body" and any(speaks_against(v, level > 0) for _, v in found):
                against *= NAMED
            if ("role", "main") in found:
                level = max(level, 1)
        level = max(level, 2 if tag == "article" else 1 if tag == "main" else 0)
        against *= NAMED if tag == "header" and not level else AGAINST.get(tag, 1.0)
        key = (self.path[parent], f"{tag}.{classes}", against, level)
        path = self.paths.setdefault(key, len(self.weight))
        if path == len(self.weight):
            self.weight.append((against, level))
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(path)
        return len(self.path) - 1

    def _read(self, page: str) -> None:
        #: open elements: tag, the block element they lie in, whether their text is unread, whether they lie in a link
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        open_at: dict[str, list[int]] = defaultdict(list)
        blocks_at: list[int] = [0]
        whole: list[str] = []
        unlinked: list[str] = []
        block = 0

        def end_block() -> None:
            if whole:
                text = " ".join("".join(whole).split())
                if text:
                    free = text if len(unlinked) == len(whole) or self.tag[block] in HEADINGS else " ".join("".join(unlinked).split())
                    self.texts.append(text)
                    self.element.append(block)
                    self.chars.append(len(free))
                    self.signs.append(len(PUNCTUATION.findall(free)))
                whole.clear()
                unlinked.clear()

        def say(text: str) -> None:
            nonlocal block
            _, element, unread, link = stack[-1]
            if not unread:
                if not whole:
                    block = element
                whole.append(text)
                if not link:
                    unlinked.append(text)

        def close_to(at: int) -> None:
            while len(stack) > at:
                tag = stack.pop()[0]
                if tag:
                    open_at[tag].pop()
                if blocks_at[-1] == len(stack):
                    blocks_at.pop()

        def last(tags: tuple[str, ...]) -> int:
            return max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

        start = at = 0
        while (at := page.find("<", at)) >= 0:
            m = OPEN.match(page, at)
            if m is None:
                sign = page[at + 1 : at + 2]
                if sign not in ("!", "?", "/") or not sign:
                    at += 1
                    continue
                if at > start:
                    say(entities.unescape(page[start:at]))
                comment = page.startswith("<!--", at)
                end = page.find("-->" if comment else ">", at + 2)
                start = at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            if at > start:
                say(entities.unescape(page[start:at]))
            end = page.find(">", m.end())
            if end >= 0 and ('"' in (between := page[m.end() : end]) or "'" in between):
                end = ATTRIBUTES.match(page, m.end()).end()
                end = end if page[end : end + 1] == ">" else -1
            if end < 0:
                start = len(page)
                break
            tag, attributes = m[2].lower(), page[m.end() : end]
            start = at = end + 1
            if m[1]:
                if tag in BLOCK:
                    end_block()
                if open_at[tag]:
                    here = open_at[tag][-1]
                    if tag in BLOCK or tag in UNREAD or here > blocks_at[-1]:
                        close_to(here)
                    elif tag == "a":  # a link that ends inside a block which opened in it
                        open_at[tag].pop()
                        for k in range(here, len(stack)):
                            stack[k] = (stack[k][0] if k > here else "", *stack[k][1:3], False)
                continue
            if tag in RAW:
                found = ENDS[tag].search(page, at)
                end = page.find(">", found.end()) if found else -1
                say(" ")
                start = at = len(page) if end < 0 else end + 1
                continue
            if tag in BLOCK:
                end_block()
                if open_at["head"] and tag != "head":
                    close_to(open_at["head"][-1])
                if tag not in KEEPS_P and (p := last(("p",))) > max(0, last(P_SCOPE)):
                    close_to(p)
                if tag in IMPLIED_END:
                    scope = max(0, last(SCOPE[tag]))
                    if ended := [k for t in IMPLIED_END[tag] for k in open_at[t][-1:] if k > scope]:
                        close_to(min(ended))
                if tag in VOID or tag == "html" or tag == "body" and open_at["body"]:
                    continue
            elif tag in VOID:
                if tag == "br":
                    say(" ")
                continue
            elif tag in UNREAD:
                say(" ")
            if tag == "a" and open_at["a"]:  # links don't nest: the open one ends here
                k = open_at["a"][-1]
                if k > blocks_at[-1]:
                    close_to(k)
                else:
                    open_at["a"].pop()
                    stack[k] = ("", *stack[k][1:])
            _, element, unread, link = stack[-1]
            if tag in BLOCK:
                blocks_at.append(len(stack))
                element = self._new(tag, attributes, element)
            elif tag in UNREAD:
                blocks_at.append(len(stack))
            open_at[tag].append(len(stack))
            stack.append((tag, element, unread or tag in UNREAD, link or tag == "a"))
        if start < len(page):
            say(entities.unescape(page[start:]))
        end_block()


def path_scores(paths: np.ndarray, chars: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The smoothed, fused ratio of each path (0, 1, ...), from its blocks in page order."""
    many = np.bincount(paths)
    near = np.convolve(np.ones(len(paths)), TAPS)[3:-3]
    fused = np.ones(len(many))
    for values, least in ((chars, 0.0), (signs, 1.0)):
        own = np.bincount(paths, values) / np.maximum(many, 1) + least
        smooth = np.bincount(paths, np.convolve(own[paths], TAPS)[3:-3] / near) / np.maximum(many, 1)
        fused *= np.sqrt(own * smooth)
    return np.log1p(np.sqrt(fused))


def _container(page: Page, mass: np.ndarray) -> np.ndarray:
    """Of every element, whether it lies in the deepest container that holds nearly all of the blocks' mass."""
    n = len(page.parent)
    direct = np.bincount(page.element, mass, n)
    total = direct.tolist()
    heavy = [-1] * n
    for e in range(n - 1, 0, -1):  # children come after their parents
        up = page.parent[e]
        total[up] += total[e]
    for e in range(1, n):
        up = page.parent[e]
        if heavy[up] < 0 or total[e] > total[heavy[up]]:
            heavy[up] = e
    top = 0
    while (c := heavy[top]) >= 0 and page.tag[c] in CONTAINERS and total[c] >= 0.8 * total[top] and direct[c] < 0.5 * total[c]:
        top = c
    inside = np.zeros(n, bool)
    inside[top] = True
    for e in range(top + 1, n):
        inside[e] = inside[page.parent[e]]
    return inside


def main_text(source: str | None, share: float = 0.1, floor: float = 0.15) -> str:
    """The blocks on content paths, joined by empty lines; share: of the page's level that a path's score must reach, and floor in any case."""
    page = Page(source or "")
    if not page.texts:
        return ""
    element = np.array(page.element)
    kinds, paths = np.unique(np.array(page.path)[element], return_inverse=True)
    chars, signs = np.array(page.chars, float), np.array(page.signs, float)
    scores = path_scores(paths, chars, signs)
    against = np.array([page.weight[k][0] for k in kinds])
    level = np.array([page.weight[k][1] for k in kinds])
    weighed = (scores * against * np.array(LEVELS)[level])[paths]
    weighed *= np.where([page.tag[e] in HEADINGS for e in page.element], HEADING, 1.0)
    if not level.any():
        weighed *= np.where(_container(page, chars * scores[paths] * against[paths])[element], 1.0, OUTSIDE)
    open_to = float(against.max())
    if open_to <= NAMED:  # a page in one form is read, one of nothing but menus and the like isn't
        return ""
    floor *= open_to
    text = float((chars * weighed).sum())
    limit = max(floor, share * float((chars * weighed**2).sum()) / text) if text else floor
    return "\n\n".join(t for t, w in zip(page.texts, weighed.tolist()) if w >= limit)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pick(pages, page_id=id_col, url=url_col, html=F.col(html_col).cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return map_slices(slim, "html", run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
