"""Pages: what is kept of odd markup, templates against a plain counter, long pages."""

import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epochlake.llm import html


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html.extract(pages).collect()}


def text(page):
    return html.main_text(html.parse(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><h1>Title</h1><p>Long main story of some words</p><div><article>Teaser</article></div></main>", "Title Long main story of some words Teaser"),
        ("<main><div class=breadcrumbs>Crumbs</div><article><p>One long story of some words</p></article></main>", "One long story of some words"),
        ("<main><h1>Headline</h1><p>Standfirst</p><article><p>One long story of some words</p></article><article>Teaser</article><ul><li><a href=x>Next one</a></ul></main>", "Headline Standfirst One long story of some words"),
        ("<article class='post has-comments'><p>Body.</p></article>", "Body."),
        ("<article class='entry comments-open'><p>Body.</p></article>", "Body."),
        ("<article class=commentary><p>Body.</p></article>", "Body."),
        ("<main class=comments><p>The only main element.</p></main>", "The only main element."),
        ("<article><p>Story of several words.</p></article><article class=comment><p>I agree</p></article>", "Story of several words."),
        ("<div id=story><p>" + "story " * 30 + "</p><p>" + "more " * 30 + "</p></div><article><p>" + "teaser " * 30 + "</p></article>", " ".join(["story"] * 30 + ["more"] * 30 + ["teaser"] * 30)),
        ("<article><p>" + "story " * 30 + "</p></article><div>Side</div><div>Other</div>", " ".join(["story"] * 30)),
        ("<form action=/p><div><h1>Head</h1><p>Text of the page.</p></div></form>", "Head Text of the page."),
        ("<form><main><p>In main</p></main></form>", "In main"),
        ("<p>Some page text.</p><form><p>Search here for what you want</p><input></form>", "Some page text."),
        ("<article><p>Real.</p><p class=advert>Buy</p><p class=comment>First!</p><ol class=commentlist><li>me too</li></ol><div class=replies>hi</div><ul class=points><li>kept</li></ul></article>", "Real. kept"),
        ("<article><header><h1>Headline</h1></header><div class='article-header'>Lead</div><p class='promo-code'>Code</p><section id='share-prices'>Prices</section><p>Body.</p></article>", "Headline Lead Code Prices Body."),
        ("<article><p>Body.</p><div class='ad'>no</div><div class='site-footer'>no</div><div id=cookieBanner>no</div><footer>no</footer><aside>no</aside></article>", "Body."),
        ("<p>Hello<!-->world</p><!--->!", "Helloworld !"),
        ("<p>a < b <3 c</p>", "a < b <3 c"),
        ("<a title=it's>Don't</a> <b title='a>b'>c</b>", "Don't c"),
        ("<nav>menu<article>never closed</article>", "never closed"),
        ("<aside><article>teaser</article></aside>text", "text"),
        ("<div class=sidebar><span class=ad>x<span>y</span>z</span></div>q", "q"),
        ("<table><tr><td>a<tr><td>b</table>c", "a b c"),
        ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>", "a b c d"),
        ("<div class='with-sidebar'>stays</div>", "stays"),
        ("a <", "a <"),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_repeated_pages_keep_their_text(spark):
    body = "<div class=content>" + "".join(f"<p>paragraph {k} with some words to fill it up</p>" for k in range(12)) + "</div>"
    rows = [(k, f"http://a.org/{k}", f"<title>{k}</title>{body}") for k in range(12)]
    rows += [(100, "http://b.org/x", body)] * 12
    rows += [(200 + k, f"http://c.org/{k}", f"{body}<p>Posted {k} days ago</p>") for k in range(12)]
    got = texts(spark, rows)
    want = text(body)
    assert all(got[k] == want for k in range(12)) and got[100] == want
    assert all(got[200 + k] == f"{want} Posted {k} days ago" for k in range(12))


@pytest.mark.parametrize("words", [10, 20, 39, 40, 200])
def test_equal_bodies_of_a_host_stay(spark, words):
    """Whatever its length: what holds four fifths of a page's words is its text, although every page of the host has it."""
    body = " ".join(f"word{k}" for k in range(words))
    got = texts(spark, [(k, f"http://a.org/{k}", f"<div><div>{body}</div></div><p>date {k}</p>") for k in range(6)])
    assert got == {k: f"{body} date {k}" for k in range(6)}


def test_templates_equal_a_plain_count(spark):
    """Hosts without articles whose pages are flat lists of div elements: a div goes by the count of different pages."""
    rows, own = [], defaultdict(list)
    for host, pages in (("two.org", 2), ("five.org", 5), ("ten.org", 10), ("wide.org", 130)):
        for k in range(pages):
            parts = [f"own words of page {host} {k} " * 6] + [f"block {b}" for b in range(12) if k % (b + 1) == 0]
            own[host].append(parts)
            rows.append((len(rows), f"https://{host}/{k}", "".join(f"<div>{p}</div>" for p in parts)))
            rows.append((len(rows), f"https://{host}/{k}", rows[-1][2]))
    got = texts(spark, rows)
    number = 0
    for pages in own.values():
        counts = Counter(p for parts in pages for p in parts)
        gone = {p for p, n in counts.items() if n >= 3 and n >= min(50, len(pages) / 2)}
        for parts in pages:
            want = " ".join(" ".join(p.split()) for p in parts if p not in gone)
            assert got[number] == got[number + 1] == want
            number += 2


def test_templates_in_articles(spark):
    rows = [(k, f"http://a.org/{k}", f"<article><p>own {k}</p><p>same prose</p><ul><li>same list</ul><ul><li><a href=x>same link</a></ul><div>Read on</div></article>") for k in range(6)]
    got = texts(spark, rows)
    assert got == {k: f"own {k} same prose same list" for k in range(6)}


def test_no_host_no_templates(spark):
    assert texts(spark, [(k, None, f"<div>same</div>{k}") for k in range(9)]) == {k: f"same {k}" for k in range(9)}


@pytest.mark.parametrize("page", ["<a " * 1_700_000, "<b>" * 800_000 + "<br>x" * 500_000, "text<br>" * 625_000, "<a b='" * 800_000 + ">"])
def test_long_pages(page):
    start = time.time()
    root = html.parse(page)
    html.delete_templates(root, {1})
    html.main_text(root)
    assert time.time() - start < 30  # seconds; a quadratic step takes hours


def test_clashing_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x")], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "tie", "marks", "gone", "content", "text", "n_chars")})
    assert html.extract(pages).select("page_id", "text", "n_chars").collect() == [(1, "x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


def test_words_of_names():
    assert all(html.marked_by_words(x) for x in ("ad", "side-bar sidebar", "mainNav", "comments-area", "cookie_banner"))
    assert not any(html.marked_by_words(x) for x in ("promo-code", "share-prices", "article-header", "badge", re.sub("x", "", "contentx")))
