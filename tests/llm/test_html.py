"""Operator 1: lines, their order of parsing, and the differencing against a plain pairwise version."""

import random
import time

import pytest

from tesserine.llm import htmltext


def texts(page):
    return [t for _, t in htmltext.lines_of(page)]


def test_only_blocks_and_breaks_end_a_line():
    page = "<p>see the <img src=x> picture and super<wbr>long <ruby>a<rt>b</rt></ruby> word <acronym>NASA</acronym> x</p>"
    assert texts(page) == ["see the picture and superlong ab word NASA x"]
    assert texts("<p>a<script>z</script>b <button>q</button>c<svg/>d<br>e<blockquote>f</blockquote>g") == ["ab cd", "e", "f", "g"]


def test_one_word_of_a_name_drops_no_article_text():
    page = '<article>a <span class="social">social</span> science<section id="related-work">work</section><p class="reply">answer</p></article>'
    assert texts(page) == ["a social science", "work", "answer"]
    assert texts('<div class="header-image-post"><p>body text</p></div>') == ["body text"]
    assert texts('<div class="no-sidebar has-comments">text</div>') == ["text"]
    for name in ("comments", "comment-list", "site-header", "cookie-notice", "adSlot", "ad ad-top", "sidebar", "related-posts", "newsletter-signup", "share-buttons", "breadcrumbs"):
        assert texts(f'<article>text<div class="{name}">x</div></article>') == ["text"], name


def test_headlines_stay_and_articles_of_others_go():
    assert texts("<header>Site</header><article><header><h1>Title of it</h1><p>By A</p></header><p>text</p><footer>tags</footer></article><footer>end</footer>") == ["Title of it", "By A", "text"]
    assert texts("<article><blockquote>said<aside>aside</aside><footer>the author</footer></blockquote><aside>advert</aside></article>") == ["said", "aside", "the author"]
    assert texts('<article>a</article><section class="discussion-thread"><article class="reply"><p>a reader says</p></article></section><article class="related-card">card</article>') == ["a"]
    assert texts('<article class="post has-comments"><p>text</p><article id="div-comment-7" class="comment-body">said</article></article>') == ["text"]
    assert texts('<article class="news-post"><header class="share-buttons">x</header>y</article><blockquote><footer>z</footer></blockquote>') == ["y"]


def test_references_and_blanks():
    assert texts("<p>&eacute;&#00000000065;&#65;&#x42; &amp;amp; a&nbsp;\n\t b &#" + "9" * 6000 + ";</p>") == ["éAAB &amp; a b �"]
    assert texts("<p>1 < 2 <3 and <b>x</b> < y") == ["1 < 2 <3 and x < y"]
    assert texts("<!-- a > b --><p title='a>b'>x<![CDATA[ <p> ]]></p><?php x ?>") == ["x"]


@pytest.mark.parametrize("part", ["<a", "a <b c", '<a x="', "<a x='>", "<a b='\">", "<h1>", "<p>", "</script ", "<script></script ", "<div>", "</x></div><div>", "<!--", "<![CDATA[", "<", "<p>a<", "<li><h1>", "<span hidden>", "<b class='ad'>x</i>", "&", "&#", "= '"])
def test_broken_pages_take_linear_time(part):
    began = time.time()
    htmltext.lines_of("<p>" + part * (200_000 // len(part)))
    htmltext.lines_of("<li><div>" + "<h1>" * 20_000 + (part + "</li>") * 20_000)
    assert time.time() - began < 5


def plain_extract(rows):
    """Each page against all others of its host in the order of path and id, as the docstring of the operator says."""
    order = sorted((r for r in rows), key=lambda r: (r[1], r[0]))
    pages = [(r[0], r[1].split("/")[2], htmltext.lines_of(r[2])) for r in order]
    out = {}
    for i, (page_id, host, lines) in enumerate(pages):
        mine = [t for _, t in lines]

        def nearest(others, mine=mine, host=host):
            got = []
            for _, h, other in others:
                other = [t for _, t in other]
                if h == host and other and not set(mine) <= set(other) and not (got and set(got[-1]) <= set(other)):
                    got.append(other)
            return got[:2]

        back, ahead = nearest(reversed(pages[:i])), nearest(pages[i + 1 :])
        near = back[:1] + ahead[:1] if back and ahead else back or ahead
        shared = []
        for other in near:
            table = [[0] * (len(other) + 1) for _ in range(len(mine) + 1)]
            for a in range(1, len(mine) + 1):
                for b in range(1, len(other) + 1):
                    table[a][b] = table[a - 1][b - 1] + 1 if mine[a - 1] == other[b - 1] else max(table[a - 1][b], table[a][b - 1])
            shared.append((table[-1][-1], htmltext.shared_lines(mine, other), other))
        for length, places, other in shared:
            assert len(places) == length
            rest = iter(other)
            assert all(mine[k] in rest for k in sorted(places))
        gone = set()
        for _, places, _ in shared:
            most = 2 * sum(len(mine[k]) for k in places) > sum(map(len, mine))
            gone |= set.intersection(*(p for _, p, _ in shared)) if most else places
        out[page_id] = "\n".join(t for k, (kind, t) in enumerate(lines) if kind == htmltext.ARTICLE or k not in gone)
    return out


def test_differencing_against_plain_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(90):
        host = rng.choice("aab")
        menu = [f"menu {host} {i}" for i in range(rng.randint(2, 4))]
        own = [f"own {rng.randint(0, 60)} line {i}" for i in range(rng.randint(0, 5))]
        body = "".join(f"<p>{t}</p>" for t in own)
        if k % 5 == 0:
            body = f"<article>{body}<p>a passage of many pages</p></article>"
        rows.append((k, f"http://{host}.example/x/{rng.randint(0, 40):02}", "".join(f"<div>{m}</div>" for m in menu) + body + f"<div>foot {host}</div>"))
    want = plain_extract(rows)
    assert sum("menu" not in t for t in want.values()) > 60 and any("passage" in t for t in want.values())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for ranges, edge in ((1, 8), (2, 1), (50, 8), (50, 1)):
        monkeypatch.setattr(htmltext, "EDGE", edge)
        assert {r["page_id"]: r["text"] for r in htmltext.extract(pages, ranges).collect()} == want


def test_a_very_long_page(spark):
    html = "<nav>menu</nav><article>" + "".join(f"<p>line {i} of it</p>" for i in range(60_000)) + "</article>"
    got = htmltext.extract(spark.createDataFrame([(1, "http://a/x", html), (2, "http://a/y", None)], "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[2] == "" and text[1].count("\n") == 59_999 and next(r["n_chars"] for r in got if r["page_id"] == 1) == len(text[1])
