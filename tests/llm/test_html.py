"""The HTML reader and the scan: whole texts, linear time, exhaustive search, ablations."""

import html
import random
import re
import time
from collections import Counter

import pytest

from meridian.llm import html_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title=it's>Hello it's me</p><p>Next don't go</p></article>", "Hello it's me Next don't go"),
        ('<p class="share">Share<p>Real text is here for all to read', "Real text is here for all to read"),
        ("<ul><li class=nav>Nav<li>Item one has several words</ul><p>Body two has several words too", "Item one has several words Body two has several words too"),
        ("<main><p>Intro</p><article>Body</article></main>", "Intro Body"),
        ("<main><h1>T</h1><p>lead</p><article>x</article></main>", "T lead x"),
        ("<article>One</article><div class=promo>buy</div><article>two</article>", "One two"),
        ("<article>a b<article>embed c</article>d e</article>", "a b embed c d e"),
        ("<nav>menu <article><p>text it is</article>", "text it is"),
        ("<article>kept</article><aside><article>related", "kept"),
        ("<p>a < b, c &lt; d &amp&am; e&#33;", "a < b, c < d &&am; e!"),
        ("<p>wo<b>r</b>d<!-- x --> and<script>if (a<b) '</p>'</script> more<br>lines</p>", "word and more lines"),
        ("<article><p>x<span class=ad>buy</span> y</p><style>p{}</style><div id=comments><article>reader</article></div></article>", "x y"),
        ("<table><tr><td>one two three four<td>five six seven eight<tr><td>nine ten eleven</table>", "one two three four five six seven eight nine ten eleven"),
        ("<p>good words stand here<a href='x>y'>and a link</a></p><p unclosed='", "good words stand hereand a link"),
        ("<!-->shown<!--->too<!-- no --!> hidden --><![CDATA[not]]>end", "showntooend"),
        ("<title>no</title><textarea><p>no</textarea><p>yes, here are words<svg><title>no</title></svg>", "yes, here are words"),
    ],
)
def test_whole_text(weights, page, want):
    assert html_text.extract(page, weights) == want


def test_scan_against_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 14)
        scores, gaps = [rng.uniform(-3, 3) for _ in range(n)], [rng.uniform(-3, 0) for _ in range(n)]
        best = max([0.0, *(sum(scores[a:b]) + sum(gaps[a + 1 : b]) for a in range(n) for b in range(a + 1, n + 1))])
        a, b = html_text.best_run(scores, gaps)
        assert sum(scores[a:b]) + sum(gaps[a + 1 : b]) == pytest.approx(best)


@pytest.mark.parametrize("piece", ["<a ", "<a<", "<div>", "</div>", "<b>", "<!--", '<a x="', "<li>", "<p class='x' ", "<b><div></b>", "<script>", "&amp", "<nav>", "<article>", "<span class=ad>", "x\n"])
def test_linear_time(weights, piece):
    n = 10_000_000 if piece == "<a " else 1_000_000
    t = time.time()
    html_text.extract(piece * (n // len(piece)), weights)
    assert time.time() - t < 10


def truth(page):
    body = re.search(r"<article>(.*?)(?:</article>|(?=<footer)|\Z)", page, re.S)[1]
    lines = re.sub("</?b>", "", re.sub("<(?:/?p|br|/?h1)>", "\n", body)).split("\n")
    return " ".join(filter(None, (" ".join(html.unescape(x).split()) for x in lines)))


def test_the_scan_decides(spark, weights):
    """Without fixed names, and without marks, the counted weights alone find the article."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for names in (True, False):
        for marks in (True, False):
            assert sum(html_text.extract(p, weights, names, marks) == truth(p) for p in pages) >= 0.99 * len(pages), (names, marks)
    bare = {f: w for f, w in weights.items() if not f.startswith("in .")}  # class names off too
    total = 0.0
    for p in pages:
        a, b = Counter(html_text.extract(p, bare, False, False).split()), Counter(truth(p).split())
        total += 2 * (a & b).total() / (a.total() + b.total())
    assert total / len(pages) > 0.96


def test_odd_rows(spark, weights):
    rows = [(1, "u", "<p>x y z", 7), (1, "u", "<p>x y z", 7), (None, None, None, 8), (2, "v", "<p>" + "word " * 300_000, 9)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html_text.main_text(d).collect())
    assert got == [(0, "", 0), (1, "x y z", 5), (1, "x y z", 5), (2, ("word " * 300_000).strip(), 1_499_999)]
    assert html_text.fit(d.limit(0)) == html_text.weights_of({})
