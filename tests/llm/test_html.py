"""Pages against a second parser on random trees, bounded layouts, and the rules of visibility."""

import random
import time
from html.parser import HTMLParser

from seqloom.llm import html_text

HIDE = ("script", "style", "template")


class _Words(HTMLParser):
    """Words in document order, by the standard library's parser; elements are hidden by attribute or name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.open, self.cell, self.cells = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr"):
            hidden = tag in HIDE or any(a == "hidden" or (a == "style" and "none" in v) for a, v in attrs)
            self.open.append(hidden or bool(self.open and self.open[-1]))

    def handle_endtag(self, tag):
        if tag not in ("br", "hr"):
            self.open.pop()

    def handle_data(self, data):
        if not (self.open and self.open[-1]):
            self.words += data.split()


def _tree(r, depth, names):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if depth == 0 or kind < 0.35:
            out.append(f" w{next(names)} &amp; ")
        elif kind < 0.5:
            tag = r.choice(("b", "i", "span", "a", "em", "svg", "math"))
            out.append(f"<{tag}>{_tree(r, depth - 1, names)}</{tag}>")
        elif kind < 0.7:
            tag = r.choice(("div", "section", "blockquote", "article"))
            hidden = r.choice(("", "", ' hidden=""', ' style="color:red;display:none"', ' style="display:none;display:block"'.replace("none;", "inline;")))
            out.append(f"<{tag}{hidden}>{_tree(r, depth - 1, names)}</{tag}>")
        elif kind < 0.8:
            out.append("<ul>" + "".join(f"<li>{_tree(r, depth - 1, names)}</li>" for _ in range(2)) + "</ul>")
        elif kind < 0.9:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td colspan={r.randint(1, 3)}>w{next(names)}</td>" for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(2)) + "</table>")
        elif kind < 0.95:
            tag = r.choice(HIDE)
            out.append(f"<{tag}>x{next(names)}</{tag}>")
        else:
            out.append(r.choice(("<br>", "<hr>")))
    return "".join(out)


def test_random_trees_have_the_second_parser_s_words():
    r = random.Random(31)
    for _ in range(300):
        page = _tree(r, 4, iter(range(10**6)))
        second = _Words()
        second.feed(page)
        second.close()
        assert [w for w in html_text.text_of(page).split() if w != "-"] == second.words, page


def test_layouts_are_bounded():
    spans = "<table>" + "<tr><td rowspan=1000 colspan=1000>x</tr>" * 160 + "</table>"
    prose = "<table><tr><td>" + "long " * 20_000 + "<td>b</tr>" + "<tr><td>a<td>b</tr>" * 2000 + "</table>"
    wide = "<table><tr>" + "".join(f"<td>{'y' * 79}</td>" for _ in range(500)) + "</tr>" + "<tr><td colspan=499><td>z</tr>" * 500 + "</table>"
    for page in (spans, prose, wide):
        began = time.time()
        text = html_text.text_of(page)
        assert time.time() - began < 5 and len(text) < 20 * len(page)
    assert html_text.text_of(prose).count("long") == 20_000 and html_text.text_of(wide).count("z") == 500
    assert html_text.text_of("<table><tr><td>a<td>b<tr><td>" + "p" * 90 + "<td>c</table>").split("\n") == ["a" + " " * 81 + "b", "p" * 90 + "  c"]


def test_cells_stand_in_columns():
    page = "<table><tr><td rowspan=2>r<td>11<td>x<tr><td>2<td>y<tr><td colspan=2>wide one<td>z<tr><td>漢字<td>é<td>end</table>"
    lines = html_text.text_of(page).split("\n")
    assert lines == ["r     11  x", "      2   y", "wide one  z", "漢字  é   end"]


def test_visibility():
    cases = {
        "<math><mi>x</mi></math>": "x", "<svg><title>t</title><text>s</text></svg>": "s", "<input type=submit value='Go on'>": "Go on", "<input type=hidden value=x>": "",
        '<p style="display:none;display:block">v': "v", '<p style="font-display:none">v': "v", '<p style="display:none !important;display:block">v': "", '<p style="DISPLAY: none">v': "", "<button>Press</button>": "Press",
    }
    for page, want in cases.items():
        assert html_text.text_of(page) == want, page


def test_rows(spark):
    schema = "page_id long, html string, text string, n_lines long"
    rows = [(1, "<p>a<p>b", "c", 9), (1, "<p>a<p>b", "c", 9), (2, None, None, None), (3, "<p>w</p>" * 30_000, "", 0)]
    got = sorted(tuple(g) for g in html_text.page_texts(spark.createDataFrame(rows, schema)).select("page_id", "n_chars", "n_lines").collect())
    assert got == [(1, 4, 3), (1, 4, 3), (2, 0, 0), (3, 89_998, 59_999)]
    assert html_text.page_texts(spark.createDataFrame([], schema)).count() == 0
