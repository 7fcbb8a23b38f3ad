import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from docgrid.llm import html_extract as H

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div><div>{shared}</div>
<article><header><h1>Title &amp; {n}</h1></header><p>First&nbsp;para <b>bold<br>line <p>Second 1 &lt; 2<form>Sign up</form>
<script>var a = "</p><p>no";</script><ul><li>one<li>two</ul><div class="share-bar">Share</div></article>
<section id="comments"><p>Reader says</p></section><aside>Side</aside><footer>&copy; x</footer>"""


def test_blocks():
    assert H.read(PAGE.format(n=1, shared="s")).text() == "Title & 1\n\nFirst para bold line\n\nSecond 1 < 2\n\none\n\ntwo"


def test_odd_pages():
    for source in (None, "", " ", "plain text", "<", "<p", "<p>a<!-- open", "</div></p>x", "<a href='x>y</a>", "<div>" * 3000 + "deep", "<![CDATA[x]]>"):
        page = H.read(source)
        page.hashes(page.parts())
        page.text()
    assert H.read("plain &amp; text").text() == "plain & text"
    assert H.read("<body><div>a</div>b<p>c").text() == "a\n\nb\n\nc"
    assert H.read("<article><p>x<article><p>y</article></article>").text() == "x\n\ny"


def test_nothing_of_the_text_is_lost():
    assert H.read("<article><svg/><p>Hello world</p><svg></svg><p>Bye</p></article>").text() == "Hello world\n\nBye"
    assert H.read('<div class="layout with-sidebar"><p>Body text</p></div>').text() == "Body text"
    assert H.read('<article><div class="related-work">A</div><p class="notice">B</p><p>C</p></article>').text() == "A\n\nB\n\nC"
    assert H.read('<div class="sidebar-right">x</div><div><p>The page\'s own words</p></div>').text() == "The page's own words"


def test_comments_go_wherever_they_stand():
    said = '<ol class="comment-list"><li><article class="comment-body"><p>First! A long comment that is longer than the article itself.</p></article></ol>'
    assert H.read(f'<main><article><p>Own words</p></article><div id="comments">{said}</div></main>').text() == "Own words"
    assert H.read(f"<article><p>Own words</p>{said}</article>").text() == "Own words"
    assert H.read('<body class="comments"><div class="comments-open"><p>Own words</p></div></body>').text() == "Own words"
    assert H.read('<article><p>Own words</p><div class="sidebar">Side</div><div class="notice">Kept</div></article>').text() == "Own words\n\nKept"


def test_time_is_linear_in_the_page():
    for piece in ("<svg/>", "<svg>", "<canvas>", "<b></i>", "<p><b>", "<li><td>", "<div></p>", "<!--x-->", "<a b='c'>"):
        began = time.time()
        H.read(piece * 40_000 + "end").text()
        assert time.time() - began < 8, piece


def test_counts_against_brute_force(spark):
    """What recurs is counted over pages of different main text, by plain dictionaries here."""
    rng = random.Random(7)
    rows = []
    for k in range(160):
        host = f"h{rng.choice([0, 0, 0, 1, 1, 2, 3])}"
        words = " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(40)) for _ in range(rng.randint(3, 40)))
        ad = f"<div class='ad ad-{k}'>Buy {rng.randrange(6)} now</div>" if rng.random() < 0.8 else ""
        box = "<section><h3>Latest</h3><ul><li>one<li>two</ul></section>" if rng.random() < 0.5 else "<section><h3>Other</h3></section>"
        body = f"<article><h1>T{k}</h1><p>{words}</p><div>Licence</div></article>" if k % 3 else f"<div id=c><p>{words}</p><p>{words}</p></div>"
        rows.append((k, f"http://{host}/{k}", f"{box}{ad}{body}tail {k % 4}"))
    rows += [(1000 + k, f"{u}?copy", h) for k, u, h in rows[:30]] + rows[:5]
    on, hosts = defaultdict(set), defaultdict(set)
    pages = {(u, h): H.read(h) for _, u, h in rows}
    told = {}
    for (u, _), p in pages.items():
        host, parts = u.split("/")[2], p.parts()
        told[u] = [(i, *c) for (i, _), c in zip(parts, p.hashes(parts))]
        hosts[host].add(p.text())
        for _, place, content in told[u]:
            on[host, place].add(p.text())
            on[host, place, content].add(p.text())
    often = lambda key: len(on[key]) >= H.MIN_PAGES and (len(on[key]) >= H.MIN_SHARE * len(hosts[key[0]]) or len(on[key]) >= H.MANY_PAGES)
    want = {}
    for (u, h), p in pages.items():
        host = u.split("/")[2]
        if len(hosts[host]) < H.MIN_PAGES:
            continue
        gone, recurs = set(), set()
        for k, (i, place, content) in enumerate(told[u]):
            if often((host, place)):
                recurs.add(k)
                uses = [len(v) for key, v in on.items() if key[:2] == (host, place) and len(key) == 3]
                stock = sum(n for n in uses if n > 1) >= H.SHARED * sum(uses)
                if (content and often((host, place, content))) or (stock and not p.inner[i]):
                    gone.add(k)
        want[u] = (gone, recurs)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keys = {r["key"]: r["url"] for r in df.select("url", F.xxhash64("url", "html").alias("key")).collect()}
    got = {keys[r["page_key"]]: (set(r["gone"]), set(r["often"])) for r in H.recurring_parts(df).collect()}
    assert got == want and sum(map(len, (g for g, _ in want.values()))) > 100
    text = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert text == {k: pages[u, h].text(*map(frozenset, want[u])) if u in want else pages[u, h].text() for k, u, h in rows}


def test_templates_are_removed(spark):
    rows = [(i, f"http://h{i % 2}.example/p{i}", f"<body><div><span>Shared box of h{i % 2}</span></div><div><p>Own words of page {i} that are long enough</p></div>", "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, "http://h0.example/", "", "x"), (None, "no url", "<p>text</p>", "x"), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(df).collect()), key=repr)
    want = [(i, t := f"Own words of page {i} that are long enough", len(t)) for i in [*range(12), 3]] + [(50, "", 0), (51, "", 0), (None, "text", 4)]
    assert got == sorted(want, key=repr)
    assert H.extract(df.limit(0)).count() == 0


def test_recurring_paragraphs_of_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>The same licence line.</p><p>Text {i}</p></article>") for i in range(10)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"The same licence line.\n\nText {r['page_id']}" for r in got)


def test_copied_articles_keep_lists_tables_and_sections(spark):
    long = " ".join(f"word{i}" for i in range(120))
    copied = f"<article><p>{long}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><section><p>last part</p></section></article>"
    box = "<div><span>Shared box</span></div>"
    rows = [(i, f"http://a.example/{i}", f"<title>{i}</title>{box}{copied}") for i in range(8)]
    rows += [(20 + i, f"http://a.example/x{i}", f"{box}<div><p>Own text {i} of a page that has no article at all</p></div>") for i in range(8)]
    rows += [(40 + i, f"http://b.example/{i}", f"<div><p>{long}</p></div><div><ul><li>one<li>two</ul></div>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(8)} == {f"{long}\n\none\n\ntwo\n\na b\n\nlast part"}
    assert all(got[20 + i] == f"Own text {i} of a page that has no article at all" for i in range(8))
    assert {got[40 + i] for i in range(8)} == {f"{long}\n\none\n\ntwo"}


def _site(n, page, host="stock.example"):
    return [(k, f"http://{host}/{k}", f"<html><body>{page(k)}</body></html>") for k in range(n)]


def test_a_stock_in_one_place_goes_and_own_parts_beside_an_article_stay(spark):
    """Without any class word: lines from a stock go by recurrence, headings and leads that differ on every page stay."""
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    page = lambda k: f"<h1>Title {'abcdefghijklmnopqrstuvwxyz'[k]}</h1><p>Lead {own(k)[:40].strip()}</p><div><span>Buy thing {k % 9} now</span></div><article><p>{own(k)}</p></article>"
    rows = _site(24, page) + [(100 + k, u.replace("stock", "tiny"), h) for k, u, h in _site(2, page)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(24):
        assert got[k] == f"Title {'abcdefghijklmnopqrstuvwxyz'[k]}\n\nLead {own(k)[:40].strip()}\n\n{own(k)}"
    # too few pages to tell: what stands beside the article goes, but for headings and paragraphs
    assert got[100] == f"Title a\n\nLead {own(0)[:40].strip()}\n\n{own(0)}"


def test_adverts_of_any_element_and_menus_of_dishes(spark):
    text = " ".join(f"word{i}" for i in range(80))
    html = f"""<html><body><article><h1>Lunch</h1><p class="ad">BUY</p><p>{text} <span class="advert">NOW</span></p><ul class="menu"><li>Soup</li><li>Bread</li></ul>
    <ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></article></body></html>"""
    got = H.extract(spark.createDataFrame([(1, "http://a.example/1", html)], "page_id long, url string, html string")).first()["text"]
    assert got == f"Lunch\n\n{text}\n\nSoup\n\nBread"


def test_extraction_by_another_parser(spark):
    """Pages of a plain template, their article read by the standard library's parser, which knows nothing of templates."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if self.inside and tag in ("p", "h1", "li"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside and self.blocks:
                self.blocks[-1] += data

    def page(k):
        body = "".join(f"<p>{' '.join(f'p{k}q{i}r{j}' for j in range(12 + k))} &amp; &eacute;</p>" for i in range(4))
        return f"<div id=top>Site</div><nav><a href=/>Home</a></nav><div class='side bar'>Links of the day {k % 3}</div><article><h1>Head {'abcdefghij'[k]}</h1>{body}<ul><li>one{k}</li><li>two{k}</li></ul></article><div>All rights reserved</div>"

    rows = _site(10, page)
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        reader = Article()
        reader.feed(html)
        assert got[k] == "\n\n".join(" ".join(b.split()) for b in reader.blocks if b.strip())
