"""Main text of pages: layouts, hostile markup, the part of the path ratios, and a plain version."""

import math
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import html_text

P1 = "This is the first paragraph of the story, and it goes on for a while. It has sentences, commas; all that a text has."
P2 = "The second paragraph tells more about it. Nobody knew, at that time, how it would end, but everybody had a guess."
P3 = "Short one."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"
STORY = f"<h1>A title</h1><p>{P1}</p><h2>Part</h2><p>{P2}</p><p>{P3}</p><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>x</td></tr></table>"
WANT = "\n\n".join(["A title", P1, "Part", P2, P3, "one", "two", "1", "x"])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{MENU}</nav><article>{STORY}</article><footer>&copy; me, all rights reserved. Do not copy.</footer></body>",
        f"<div id=top-menu>{MENU}</div><main>{STORY}<aside><p>{P2}</p></aside></main><div>{P1}</div>",
        f"<div class=x1>{MENU}</div><div class=x2>{STORY}</div><div class=x3>{MENU}</div>",
        f"<div class=wrap><div>{MENU}</div><div><section>{STORY}</section><div class='user-comments'><p>{P1}</p></div></div><div class=cookie_notice><p>{P2}</p></div></div>",
        f"<table><tr><td>{MENU}</td><td>{STORY}</td></tr></table>",
        f"<form><div class=sidebar><p>{P1}</p></div><div>{STORY}</div></form>",
        f"<article><div class=post-header><h1><a href=/self>A title</a></h1></div>{STORY[len('<h1>A title</h1>'):]}<div class=share-buttons>Share this page, please.</div><div>{MENU}</div></article>",
        f"<article>{STORY.replace('</li>', '').replace('</p>', '').replace('</td>', '')}</article><div class=ad>{P1}</div>",
    ],
)
def test_layouts(page):
    assert html_text.main_text(page) == WANT


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>a<select-list>b</select-list> c.</p><p>d</p></article>", "ab c.\n\nd"),
        ('<article><p>a.</p><div class="legal-history"><p>b, c.</p></div><div id="share-price">d.</div></article>', "a.\n\nb, c.\n\nd."),
        ('<article><p>a.</p><script src="a.js"/> var leak=1; </script><p>b.</p></article>', "a.\n\nb."),
        ('<article title="a > b"><p data-class="ad" title=\'<p>\'>a &lt;b&gt; &amp;amp; c</p></article>', "a <b> &amp; c"),
        ("<article><a href=/><div>in a link</div></a><p>a, b.</p></article>", "a, b."),
        ("<article><p>a.<button><b>no</b></button><svg><text>no</text></svg> b</p><textarea><p>no</textarea></article>", "a. b"),
        ("<p>a<b c", "a"),
        ("<article><p>1 < 2 <!- x> and 3</p></article>", "1 < 2 and 3"),
        ("<nav>only a menu, of many words. And more.</nav>", ""),
        (f"<nav>{MENU}</nav>{MENU}", ""),
        ("<article><p>x</p></article><footer>A long footer, with commas; and sentences. It is much longer than the article.</footer>", "x"),
    ],
)
def test_markup(page, text):
    assert html_text.main_text(page) == text


WITH_LINKS = f"<article>{STORY}<div>{MENU}</div></article>"
WITHOUT = f"<div>{MENU}</div>{STORY}<div>{MENU}</div>"


@pytest.mark.parametrize("page", [WITH_LINKS, WITHOUT])
def test_the_path_ratios_choose(monkeypatch, page):
    assert html_text.main_text(page) == WANT
    monkeypatch.setattr(html_text, "path_scores", lambda paths, chars, signs: np.ones(paths.max() + 1))
    assert "Section 3" in html_text.main_text(page)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<script " * 130_000, '<a b="' * 160_000, "<div>" * 60_000 + "x", "<b>" * 60_000 + "<p>t" * 60_000, "".join(f"<div class=c{i}>text, {i}.</div>" for i in range(50_000)), "<" * 1_000_000, "<ul><li>" * 60_000])
def test_hostile_pages_end(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 10


class Tree(HTMLParser):
    """Blocks of a well-formed page, with all their ancestors written out."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.serial = [("", "", 0)], [], 0

    def handle_starttag(self, tag, attrs):
        self.serial += 1
        self.open.append((tag, " ".join(v for k, v in attrs if k == "class"), self.serial))
        self.text = ""

    def handle_data(self, data):
        self.blocks.append((list(self.open), data, any(t == "a" for t, _, _ in self.open)))

    def handle_endtag(self, tag):
        self.open.pop()


def plain_main_text(page):
    tree = Tree()
    tree.feed(page)
    rows = []
    for chain, text, link in tree.blocks:
        chain = [x for x in chain if x[0] != "a"]
        heading = chain[-1][0] in ("h1", "h2")
        level = 2 if any(t == "article" for t, _, _ in chain) else 0
        against = 0.01 ** sum(t in ("nav", "footer") or c == "ads" for t, c, _ in chain)
        counted = "" if link and not heading else text
        rows.append([tuple((t, c) for t, c, _ in chain), chain, text, len(counted), sum(x in ".,;:!?" for x in counted), heading, level, against])

    def mean(of, path):
        found = [v for v, r in zip(of, rows) if r[0] == path]
        return sum(found) / len(found)

    def smoothed(column, least):
        own = [mean([r[column] for r in rows], r[0]) + least for r in rows]
        near = [[(math.exp(-((i - j) ** 2) / 2), own[j]) for j in range(len(rows)) if abs(i - j) <= 3] for i in range(len(rows))]
        smooth = [sum(w * v for w, v in x) / sum(w for w, _ in x) for x in near]
        return [math.sqrt(o * mean(smooth, r[0])) for o, r in zip(own, rows)]

    score = [math.log1p(math.sqrt(a * b)) for a, b in zip(smoothed(3, 0), smoothed(4, 1))]
    if any(r[6] for r in rows):
        inside = [True] * len(rows)
    else:
        mass = [r[3] * s * r[7] for r, s in zip(rows, score)]
        within = lambda e: sum(m for m, r in zip(mass, rows) if e in r[1])
        top = ("", "", 0)
        while True:
            below = {r[1][r[1].index(top) + 1] for r in rows if top in r[1] and r[1][-1] != top}
            best = max(sorted(below, key=lambda e: e[2]), key=within, default=None)
            direct = sum(m for m, r in zip(mass, rows) if r[1][-1] == best)
            if best is None or best[0] not in ("div", "section") or within(best) < 0.8 * within(top) or direct >= 0.5 * within(best):
                break
            top = best
        inside = [top in r[1] for r in rows]
    weighed = [s * r[7] * (120 if r[6] else 1) * (2 if r[5] else 1) * (1 if i else 1 / 8) for s, r, i in zip(score, rows, inside)]
    if max((r[7] for r in rows), default=0) <= 0.01:
        return ""
    total = sum(r[3] * w for r, w in zip(rows, weighed))
    limit = max(0.15, 0.1 * sum(r[3] * w * w for r, w in zip(rows, weighed)) / total) if total else 0.15
    return "\n\n".join(r[2] for r, w in zip(rows, weighed) if w >= limit)


def random_page(rng):
    def text():
        return "".join(rng.choice(["word", "other", "thing", "x"]) + rng.choice([" y", ", y", ". y", " z"]) for _ in range(rng.choice([1, 1, 3, 20])))

    def part(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "p", "h2", "li", "div", "section", "nav", "footer", "link", "ads", "article"])
            if kind == "link":
                out += f'<div class="m"><a href="/">{text()}</a></div>'
            elif kind == "ads":
                out += f'<div class="ads"><p>{text()}</p></div>'
            elif kind in ("div", "section", "nav", "footer", "article") and depth and (kind != "article" or rng.random() < 0.3):
                out += f"<{kind}>{part(depth - 1)}</{kind}>"
            elif kind in ("p", "h2"):
                out += f"<{kind}>{text()}</{kind}>"
            elif kind == "li":
                out += f"<ul><li>{text()}</li><li>{text()}</li></ul>"
        return out

    return f"<div>{part(4)}</div>"


def test_equals_a_plain_version():
    rng = random.Random(31)
    seen = set()
    for _ in range(600):
        page = random_page(rng)
        want = plain_main_text(page)
        assert html_text.main_text(page) == want, page
        seen.add(len(want) > 0)
    assert seen == {True, False}
