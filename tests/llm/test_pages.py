import time

import numpy as np

from roadlens.llm.pages import blocks, extracted, made_page, train_labeller

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies. Accept</div>
<article><h1>A caf&eacute; &amp; more</h1><p><b>First  line,<br>second
line.<p>Another paragraph of the text, with &#8220;quotes&#8221; in it.</p><div class="ad">Buy now</div><p>The end of it.</p>
<section class="comments"><div class="comment"><p>Great post, thanks for sharing!</p></div></section></article>
<aside class="sidebar"><a href="/x">Most read</a></aside><form><label>Email</label><button>Send</button></form><footer>&copy; 2020 All rights reserved</footer></body></html>"""
TEXT = "A café & more\n\nFirst line, second line.\n\nAnother paragraph of the text, with “quotes” in it.\n\nThe end of it."


def test_blocks():
    got = blocks(PAGE)
    assert [b.text for b in got][:4] == ["Home", "About us", "We use cookies. Accept", "A café & more"]
    assert [b.text for b in blocks("a < b <p>x<br/>y &lt;p&gt; <img alt='>'>z <unclosed")] == ["a < b", "x y <p> z <unclosed"]
    assert blocks(None) == [] and blocks("<script>only") == [] and len(blocks("<p>x" * 50_000)) == 50_000


def test_made_pages_left_out_of_training():
    rng = np.random.default_rng(77)
    words = [f"{a}{b}en" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "au")]
    model = train_labeller([], made=600)
    right = total = 0
    for _ in range(120):
        page, y = made_page(rng, words)
        found = blocks(page)
        if len(found) == len(y):
            right += (model.content([found])[0] == np.array(y, bool)).sum()
            total += len(y)
    assert right / total > 0.96


def test_extracted(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, None, "<html><nav><a>Menu</a></nav></html>"), (1, "u", PAGE), (None, "x", PAGE)]
    got = extracted(spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r["text"] for r in got] == [TEXT, "", "", "", TEXT, TEXT] and all(r["n_chars"] == len(r["text"]) for r in got)


def test_malformed_pages_take_linear_time():
    n = 40_000
    pages = ["<a " * n, "<textarea>" * n, "<svg>" * n, "<a '" * n, '<a ">" ' * n + '"', "<!--" * n, "<p><b>" * n, "<div>x" * n + "</span>" * n, "<td><p>" * n + "<div></div>" * n, "<p>" + "<b>" * n + "<i></i>" * n, "&" * n]
    for page in pages:
        began = time.process_time()
        blocks(page)
        assert time.process_time() - began < 6, page[:12]
    assert [b.text for b in blocks("<!-- a > b --><p>x<!DOCTYPE y>z<!-- never")] == ["xz"] and [b.text for b in blocks("<textarea>a<p>b<svg>c</svg>d")] == ["a", "bd"]


def test_very_long_pages(spark):
    page = PAGE.replace("</article>", "<p>more of the text, and more of it.</p>" * 50_000 + "</article>")
    rows = [(1, "u", page), (2, "u", "<a " * 300_000), (3, "u", PAGE), (4, "u", "<article><p>" + "long words of one block " * 50_000)]
    got = {r["page_id"]: r for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == TEXT and got[4]["n_chars"] > 1_100_000 and len(got) == 4
    assert got[1]["text"].count("more of the text") > 45_000


#: Labelled by hand; none of these has an article or main element.
PLAIN = [
    (
        """<html><body><div id="header"><h1>The Daily</h1><ul class="menu"><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></div>
<div class="content"><h2>River rises after a week of rain</h2><p>The river rose by two metres in a night, and the lower road is closed until the water falls.</p>
<p>Farmers moved their cattle to the hills on Sunday, said the head of the council.</p><div class="ad">Buy now and save, free shipping on all offers</div><p>More rain is expected.</p></div>
<div class="sidebar"><h3>Most read</h3><a href="/1">Ten trips for the summer</a></div><div id="footer">&copy; 2021 The Daily. All rights reserved.</div></body></html>""",
        ["River rises after a week of rain", "The river rose by two metres in a night, and the lower road is closed until the water falls.", "Farmers moved their cattle to the hills on Sunday, said the head of the council.", "More rain is expected."],
    ),
    (
        """<body><div class="cookie-banner">We use cookies. Accept all</div><div class="nav"><a href="/">Start</a> <a href="/b">Blog</a></div><div class="post"><h1>How to mend a chair</h1>
<p>First take off the seat and look at the joints, one after the other.</p><ul><li>Glue the loose ones.</li><li>Clamp them for a day.</li></ul></div>
<div class="comments"><p>Great, thanks for sharing this!</p><p>I did the same last year.</p></div><form><label>Your email</label><button>Subscribe</button></form></body>""",
        ["How to mend a chair", "First take off the seat and look at the joints, one after the other.", "Glue the loose ones.", "Clamp them for a day."],
    ),
]


def test_pages_labelled_by_hand():
    model = train_labeller([], made=600)
    right = total = 0
    for page, wanted in PLAIN:
        found = blocks(page)
        keep = model.content([found])[0]
        right += sum(k == (b.text in wanted) for b, k in zip(found, keep))
        total += len(found)
    assert right >= 0.85 * total
