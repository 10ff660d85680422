"""Main text of pages: densities against brute force, odd markup and odd rows."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from slideloom.llm import html_text

LONG = "Plain words of a long paragraph that says a good deal about its subject. " * 4


class Tree(HTMLParser):
    """Every element of well-formed markup with its characters, tags and the same inside links."""

    def __init__(self, page):
        super().__init__()
        self.root = self.here = {"name": "body", "up": None, "kids": [], "c": 0, "t": 0, "lc": 0, "lt": 0}
        self.nodes = [self.root]
        self.feed(page)

    def above(self):
        node = self.here
        while node:
            yield node
            node = node["up"]

    def handle_starttag(self, tag, attrs):
        for node in self.above():
            node["t"] += 1
            node["lt"] += tag == "a"
        node = {"name": tag, "up": self.here, "kids": [], "c": 0, "t": 0, "lc": 0, "lt": 0}
        self.here["kids"].append(node)
        self.nodes.append(node)
        self.here = node

    def handle_endtag(self, tag):
        self.here = self.here["up"]

    def handle_data(self, data):
        n = len(data.replace(" ", ""))
        linked = any(node["name"] == "a" for node in self.above())
        for node in self.above():
            node["c"] += n
            node["lc"] += n * linked


def plain_density(node, root):
    c, t, lc, lt = node["c"], max(1, node["t"]), node["lc"], node["lt"]
    if not c:
        return 0.0
    x = c / max(1, c - lc) * lc + max(1, root["lc"]) / root["c"] * c + math.e
    return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt), math.log(x)))


def test_densities_match_brute_force():
    rng = random.Random(6)

    def words():
        return " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12)))

    def inline(depth):
        tag = rng.choice(["b", "a", "span", "em"])
        return f"<{tag}>{words()}{inline(depth - 1) if depth and rng.random() < 0.4 else ''}</{tag}>"

    def block(depth):
        if not depth or rng.random() < 0.3:
            return f"<p>{words()}{inline(2) if rng.random() < 0.5 else ''}{words()}{inline(1) if rng.random() < 0.3 else ''}</p>"
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(block(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    for _ in range(60):
        page = "".join(block(4) for _ in range(4))
        tree = Tree(page)
        want = [(n["name"], plain_density(n, tree.root), sum(plain_density(k, tree.root) for k in n["kids"])) for n in tree.nodes if n["name"] in html_text.BLOCKS]
        root = html_text.parse(page)
        html_text.densities(root)
        got, stack = [], [root]
        while stack:
            b = stack.pop()
            got.append((b.name, b.density, b.sum))
            stack.extend(reversed(b.children))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(g[i], w[i], rel_tol=1e-9, abs_tol=1e-12) for g, w in zip(got, want, strict=True) for i in (1, 2))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<p>Before {LONG}</p><svg/><p>After</p>", f"Before {LONG}\n\nAfter"),
        (f"<p data-x=it's>{LONG}</p><p>b {LONG}</p>", f"{LONG}\n\nb {LONG}"),
        (f"<p title='a > b'>{LONG}</p>", LONG),
        (f"<p>a <svg><path d='x'/></svg>b <button>no</button>c {LONG}</p>", f"a b c {LONG}"),
        (f"<main><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Tiny.</p></div></main>", f"Title\n\n{LONG}\n\n{LONG}\n\nTiny."),
        (f"<div data-id=sidebar><p>{LONG}</p></div>", LONG),
        ("<title>t</title><p>One", "One"),
        ("<script>var x = '<p>no</p>'", ""),
    ],
)
def test_odd_markup(page, text):
    assert html_text.main_text(page) == "\n\n".join(x.strip() for x in text.split("\n\n"))


NAMES = "comments-section comment-thread comment-body commentlist js-comments-app ad-container ad-wrapper newsletter-signup related-posts footer-inner nav-wrapper sidebar-inner cookie-message disclaimer site-footer"
SHORT = "A short remark of three words or more. "


@pytest.mark.parametrize("name", NAMES.split())
@pytest.mark.parametrize("frame", ["<article><h1>T</h1><p>{}</p>{}</article>", "<div><div><h1>T</h1><p>{}</p></div>{}</div>"])
def test_parts_marked_by_longer_names_go(name, frame):
    for kind in ("class", "id"):
        assert html_text.main_text(frame.format(LONG * 3, f'<div {kind}="{name}"><p>{SHORT}</p><p>{SHORT}</p></div>')) == f"T\n\n{(LONG * 3).strip()}"


@pytest.mark.parametrize("name", "post-content article-body has-sidebar search-results header-image entry story-text content-main commentary no-comments".split())
def test_parts_with_other_names_stay(name):
    assert html_text.main_text(f'<article><h1>T</h1><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>') == f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["header", "banner", "masthead", "page-header"])
def test_headlines_in_the_head_of_an_article_stay(name):
    assert html_text.main_text(f'<div class="{name}"><p>Site</p></div><article><div class="{name}"><h1>Title</h1></div><p>{LONG}</p></article>') == f"Title\n\n{LONG.strip()}"
    assert html_text.main_text(f'<article><div class="{name}"><p>{SHORT}</p></div><h1>Title</h1><p>{LONG}</p></article>') == f"Title\n\n{LONG.strip()}"


def test_the_density_chooses_among_parts(monkeypatch):
    teasers = "".join(f"<article><h2><a href=x>Teaser {i}</a></h2><p><a href=x>Read on here</a></p></article>" for i in range(4))
    links = "<div><ul>" + "".join(f"<li><a href=x>Some other page {i}</a></li>" for i in range(30)) + "</ul></div>"
    pages = {
        teasers + f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>": f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}",
        f"{links}<div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></div>{links}": f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}",
        teasers + f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>" + teasers: "\n\n".join([LONG.strip()] * 3),
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text

    def first_article(root):
        html_text.densities(root)
        order = [root]
        for block in order:
            order.extend(block.children)
        return [next((b for b in order if b.name == "article"), root)]

    monkeypatch.setattr(html_text, "_marked", first_article)  # so these pages do need the density
    assert all(html_text.main_text(page) != text for page, text in pages.items())


def plain_choice(tree):
    """The places (in page order of elements) of the largest density sum and of the threshold on its path, on plain trees of blocks."""
    sums = [sum(plain_density(k, tree.root) for k in n["kids"]) for n in tree.nodes]
    best = tree.nodes[max(range(len(sums)), key=lambda i: (sums[i], -depth(tree.nodes[i]), -i))]
    path, node = [], best
    while node:
        path.append(plain_density(node, tree.root))
        node = node["up"]
    return max(sums), min(path)


def depth(node):
    return 0 if node["up"] is None else 1 + depth(node["up"])


def test_the_chosen_subtree_matches_brute_force():
    rng = random.Random(9)

    def block(d):
        if not d or rng.random() < 0.3:
            link = rng.random() < 0.3
            return f"<p>{'<a>' if link else ''}{'x ' * rng.randrange(1, 60)}{'</a>' if link else ''}</p>"
        return f"<div>{''.join(block(d - 1) for _ in range(rng.randrange(1, 5)))}</div>"

    for _ in range(80):
        page = "".join(block(4) for _ in range(3))
        largest, threshold = plain_choice(Tree(page))
        root = html_text.parse(page)
        marked = html_text._marked(root)
        chosen = html_text._highest(root)
        assert math.isclose(chosen.sum, largest, rel_tol=1e-9)
        assert chosen in marked and all(b is chosen or b.density >= threshold * (1 - 1e-9) or b.parent is not None for b in marked)
        outside = [b for b in marked if b is not chosen and b.name == "p"]
        assert all(b.density >= threshold * (1 - 1e-9) for b in outside)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</section>" * 20_000, "<span>" * 20_000 + "</i>" * 20_000, "<header>" * 20_000, "<li>" * 20_000 + "<div>" * 10_000 + "</td>" * 20_000, "<div>" * 20_000 + "<p>x"])
def test_deep_pages_are_read_in_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 2


def test_markup_that_never_ends_is_read_in_linear_time():
    for part in ("<a", "<p x='", '<p x="', "<svg>", "<b>", "<!--", "</", "<p a=\"'"):
        html_text.main_text(part * 50_000)


def test_odd_rows(spark):
    long = f"<article><p>{'word ' * 100_000}</p></article>"
    rows = [(1, None, "u", "clash", "9"), (2, "", None, None, None), (2, "", None, None, None), (3, "<p>One &lt;two&gt;  three</p>", "u", "x", "y"), (None, long, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars string")
    got = html_text.extract_text(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got[:4]] == [(1, "u", "", 0), (2, None, "", 0), (2, None, "", 0), (3, "u", "One <two> three", 15)]
    assert got[4].text == ("word " * 100_000).strip() and got[4].n_chars == 499_999
    assert html_text.extract_text(pages.where("false")).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract_text(pages.where("false")).count() == 0
