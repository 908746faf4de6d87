"""Operator 9 against a plain reading of pages by the standard parser, and in
odd cases."""

import html.parser
import time

import pytest

from tagmeter.llm import html as op

SF = "/root/testdata/sf0.01"


class Plain(html.parser.HTMLParser):
    """Blocks of the one article of a well-marked page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.line, self.inside, self.skip = [], "", False, 0

    def end_line(self):
        if text := " ".join(self.line.split()):
            self.blocks.append(text)
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line += " "
        elif tag not in op.INLINE:
            self.end_line()
        if tag == "article":
            self.inside = True
        if tag in op.FURNITURE or dict(attrs).get("class") == "ad":
            self.skip += 1
            self.opened = tag

    def handle_endtag(self, tag):
        if tag not in op.INLINE:
            self.end_line()
        if tag == "article":
            self.inside = False
        if self.skip and tag == self.opened:
            self.skip -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line += data


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.end_line()
    return "\n".join(p.blocks)


def pages_of(spark):
    return [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]


def test_every_page_by_brute_force(spark):
    want = {i: plain(h) for i, h in pages_of(spark)}
    got = {r.page_id: r for r in op.op9_html(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_windows_find_the_text_without_marks(spark):
    """Pages whose article is a plain div: surge and dive alone."""
    pages = [(h, plain(h)) for _, h in pages_of(spark)]
    same = sum(op.extract(h.replace("<article", "<div").replace("</article", "</div")) == want for h, want in pages)
    assert same >= 0.95 * len(pages)


def naive(weight, window, need):
    out, i = [], 0
    while i < len(weight):
        if weight[i] and sum(weight[i : i + window]) >= need:
            j = i + 1
            while j < len(weight) and sum(weight[j : j + window]) > 0:
                j += 1
            out.append((i, j))
            i, need = j, 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_passages(window):
    import random

    rng = random.Random(window)
    for _ in range(300):
        weight = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randrange(25))]
        assert op.passages(weight, window, 80) == naive(weight, window, 80)


LONG = "word " * 40
CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("plain", "plain"),
    ("<p>short</p>", "short"),
    ("a < b &amp; c &lt;i&gt; <b", "a < b & c <i>"),
    ("<html><head><title>x</title><body><article><p>Text</article>", "Text"),
    ("<html><head><meta><p>Text", "Text"),
    ('<div class="layout has-sidebar"><article><p>Body</article></div>', "Body"),
    ('<div class="sidebar"><article><p>Body</article></div>', "Body"),
    ('<article><div class="entry comment-free"><p>Body', "Body"),
    ('<article><p class="share-price">Shares at 10</p><p>x', "Shares at 10\nx"),
    ("<article><p>The <math><mi>x</mi></math> and <svg><text>5</text></svg> here</p>", "The x and 5 here"),
    ('<article><ul><li class="ad">buy<li>keep<li>this</ul><p>end</article>', "keep\nthis\nend"),
    (f"<p>{LONG}</p><div class=ad>a</div><div class=ad>b</div><div class=ad>c</div><p>The end.</p>", LONG.strip() + "\nThe end."),
    ('<article><p>Text <span class="ad">buy</span> more</p></article>', "Text more"),
    ("<form><article><p>only text</article></form>", "only text"),
    (f"<section id=comments><article><p>{LONG}</article></section><div>{LONG * 2}</div>", (LONG * 2).strip()),
    # windows overrule marked content that is next to nothing beside a long text
    ("<article><p>teaser</p></article>" + "<p><a>more</a></p>" * 3 + f"<div><p>{LONG * 20}</p></div>", (LONG * 20).strip()),
    # furniture by compound names
    ('<article><p>Text</p><div class="cookie-banner">We use</div><div id="post-comments">hi</div><div class="ad-slot">buy</div></article>', "Text"),
    ("<article><p>A</p><nav><a>x</a></nav><h2>B</h2><script>var a = '</p>';</script><style>p{}</style><p>C</article>", "A\nB\nC"),
    ("<article><p>one<br>two\n three&nbsp;four</p></article>", "one two three four"),
    ("<svg-icon></svg-icon><p>after</p>", "after"),
    ("<select><p>after an open select</p>", "after an open select"),
    ('<article title="a > b"><p>Text', "Text"),
    ('<article><a href="x">all link</a><p>Text', "all link\nText"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert op.extract(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "</p>" * 100_000, "<a b" * 300_000 + "'>", '<a b="' * 300_000, "<!--" * 300_000, "<div class=ad>" * 100_000 + "x", "<li>x" * 200_000,
        "<select>" * 200_000, "<a href='x' b=\"y" * 100_000, "<article>" * 100_000 + "x", "<span class=ad>" * 100_000 + "</b>" * 100_000, "<p>" + "word " * 1_000_000,
    ],
    ids=range(11),
)
def test_time_is_linear(page):
    began = time.perf_counter()
    op.extract(page)
    assert time.perf_counter() - began < 20


def test_whole_long_page():
    body = "".join(f"<p>{i} {LONG}</p>" for i in range(25_000))
    got = op.extract(f"<nav>menu</nav><article>{body}</article>")
    assert got == "\n".join(f"{i} {LONG.strip()}" for i in range(25_000)) and len(got) > 5_000_000


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a</article>"), (3, "u", "<article><p>a</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as n_chars")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in op.extract_text(df).collect())
    assert got == [(1, "u", "", 0), (2, "", "", 0), (3, "u", "a", 1), (3, "u", "a", 1)]
    assert op.extract_text(df.limit(0)).count() == 0
