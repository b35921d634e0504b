"""Main text of pages: a plain parse of the given pages, planted pages without an article, and windows against brute force."""

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from marginalia.llm import html, queries

D = "/root/testdata/sf0.001"
BREAK = {"p", "br", "h1", "li", "ul", "div", "article"}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.parts.append(" " if tag in BREAK else "")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.parts.append(" " if tag in BREAK else "")

    def handle_data(self, data):
        self.parts.append(data if self.inside else "")


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return " ".join("".join(p.parts).split())


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    rows = queries.QUERIES["op12_host_suffix_extraction"](spark, D).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["text"] == plain(page["html"]) and r["n_chars"] == len(r["text"])
        # the heading stands in the article, the footer does not
        assert r["text"].startswith(plain("<article>" + re.search("<h1>.*?</h1>", page["html"])[0])) and "©" not in r["text"]
    assert sum(r["n_repeated"] for r in rows) > 0


def kept(page):
    return " ".join(t for t, _, sure in html.settled(html.blocks(page)) if sure)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("no markup at all", ""),
    ("<article>a <b>b</b>c<br>d\n\n e</article>", "a bc d e"),
    ("<article><p>a<p>b &amp; &lt;c&gt; &eacute;&#233;&nbsp;x &am</article> out", "a b & <c> éé x &am"),
    ("<ARTICLE><H1>T</H1><script>var a = '<p>no</p>';</script><style>p{}</style>b<!-- c <p> --> d</ARTICLE>", "T b d"),
    ("<header>no</header><article><header><h1>T</h1></header>a<footer>no</footer></article><footer>no</footer>", "T a"),
    ("<nav><a>no</a></nav><main><p>a</p><aside>no</aside><form><input>no</form></main>", "a"),
    ('<main><article>a<div class="newsletter-box">no</div><section id="comments"><article>no</article></section></article><div>no</div></main>', "a"),
    ('<article class="post no-sidebar"><div class="SideBar">no</div><div class="body">a</div><p class="cookieNotice">no</p><p hidden>no</p></article>', "a"),
    ('<article>a</div></section></p>b</article>', "a b"),
    ('<div><article><div>a</article>no', "a"),
    ('<article><a href="x>y" title=\'>\' data=">">a</a> <img alt="a > b"> 1 < 2 <3 <- b', "a 1 < 2 <3 <- b"),
    ('<article>a<svg><text>no</text></svg><table><tr><td>b<td>c</table><button>no</button><select><option>no</select>d', "a b c d"),
    ('<article>a<p class="x', "a"), ("<article>a<!-- no", "a"), ("<article>a<script>no", "a"), ("<article>a</article", "a"),
    ("<article></article><main>b</main>", "b"),
    ("<article>" + "<p>" * 5000 + "a" + "<i>" * 5000 + "b", "ab"),
])
def test_markup(page, text):
    assert kept(page) == text


def test_windows_equal_brute_force():
    rng = np.random.default_rng(5)
    for symbols in (3, 40, 5000):
        contexts = [rng.integers(0, symbols, rng.integers(html.WINDOW, 40)).astype(np.int32) for _ in range(40)]
        contexts += [np.concatenate([c[3:], c[:5]]) for c in contexts[:15] if len(c) > html.WINDOW + 3]
        low = rng.integers(0, 6, len(contexts))
        high = low + rng.integers(0, 2, len(contexts))
        pages = defaultdict(set)
        for c, a, b in zip(contexts, low, high, strict=True):
            for i in range(len(c) - html.WINDOW + 1):
                pages[tuple(c[i : i + html.WINDOW])] |= {a, b}
        for c, found in zip(contexts, html.repeated_windows(contexts, low, high), strict=True):
            assert found.tolist() == [len(pages[tuple(c[i : i + html.WINDOW])]) > 1 for i in range(len(c) - html.WINDOW + 1)]


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_pages_without_an_article(spark, monkeypatch, crowd):
    """Unmarked menus, notices and footers of a host go, what is a page's own stays, and so does what copies of a page share."""
    monkeypatch.setattr(html, "MOST_CLASSES", crowd)
    rng = np.random.default_rng(7)
    menu, notice, end = words(rng, 12), words(rng, 20), words(rng, 9)
    own = [words(rng, 30) for _ in range(20)]
    page = lambda text: f"<body><div>{menu}</div><div><h2>{text[:20]}</h2><p>{text}</p><p>{notice}</p></div><div>{end}</div></body>"
    rows = [(i, f"http://A.example.org/{i}", page(t)) for i, t in enumerate(own)]
    # a page that another host has too, copies under another address, an article that stands on all pages, two articles of which one repeats
    rows += [(100, "http://b.example.org/", page(own[0])), (101, "http://a.example.org/copy", page(own[1])), (102, "http://a.example.org/5", f"<article>{notice}</article><p>{menu}</p>")]
    more = [words(rng, 30) for _ in range(2)]
    rows += [(103 + i, f"http://a.example.org/n{i}", f"<article>{notice}</article><article>{t}</article>") for i, t in enumerate(more)]
    rows += [(200, None, None), (201, None, ""), (None, "http://a.example.org/", "<p>short</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(own):
        assert got[i] == f"{t[:20]} {t}", i
    assert got[100] == f"{menu} {own[0][:20]} {own[0]} {notice} {end}" and got[101] == got[1] and got[102] == notice
    assert [got[103], got[104]] == more
    assert got[200] == got[201] == "" and got[None] == "short"


def test_against_all_windows_of_a_host(spark):
    """Repeated tokens of planted streams, counted by brute force, with a host that has nearly all pages."""
    rng = np.random.default_rng(9)
    pool = [words(rng, 3) for _ in range(12)]
    rows = [(i, "http://x.org/" if i % 9 else f"http://y{i}.org/", " ".join(f"<p>{pool[k]}</p>" for k in rng.integers(0, 12, 9))) for i in range(120)]
    streams, pages = {}, defaultdict(set)
    for i, url, page in rows:
        s = streams[i] = (url, html.stream(html.settled(html.blocks(page))))
        for k in range(len(s[1]) - html.WINDOW + 1):
            pages[url, tuple(s[1][k : k + html.WINDOW])].add(tuple(s[1]))
    want = {}
    for i, (url, s) in streams.items():
        hit = {k + j for k in range(len(s) - html.WINDOW + 1) if len(pages[url, tuple(s[k : k + html.WINDOW])]) > 1 for j in range(html.WINDOW)}
        want[i] = sum(k in hit for k in range(len(s)) if s[k] != "\n")
    got = {r["page_id"]: r["n_repeated"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and any(want.values())


def test_clashing_names_long_pages_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "http://a.org/", "<article>" + "a b " * 100_000 + "</article>", 1)], "text string, url string, html string, n_chars int")
    out = html.extract(df, id_col="text")
    assert out.columns == ["text", "url", "_text", "n_chars", "n_repeated"] and out.first()["n_chars"] == 399_999
    assert html.extract(df.limit(0), id_col="text").collect() == []


def test_articles_are_asked_too(spark):
    """What articles share is found, and the article still stays whole; a card that all pages show yields to a page's own text, which
    stays although an article elsewhere quotes it."""
    rng = np.random.default_rng(11)
    quote, card = words(rng, 15), words(rng, 10)
    own = [words(rng, 30) for _ in range(6)]
    rows = [(i, f"http://a.org/{i}", f"<div>{words(rng, 9)}</div><article><p>{t}</p><p>{quote}</p></article>") for i, t in enumerate(own[:2])]
    rows += [(2 + i, f"http://a.org/c{i}", f"<article>{card}</article><div><p>{t}</p></div>") for i, t in enumerate(own[2:4])]
    # the first article without markup, and copies of one article under menus of their own
    rows += [(4, "http://a.org/print", f"<p>{own[0]}</p><p>{words(rng, 9)}</p>")]
    rows += [(5 + i, f"http://a.org/d{i}", f"<div>{words(rng, 9)}</div><article>{own[4]}</article>") for i in range(2)]
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == (f"{own[0]} {quote}", 45) and got[1] == (f"{own[1]} {quote}", 15)
    assert got[2] == (own[2], 10) and got[3] == (own[3], 10)
    assert got[4][0].startswith(own[0]) and len(got[4][0].split()) == 39
    assert got[5] == got[6] == (own[4], 30)


@pytest.mark.parametrize("crowd", [2_000, 2])
def test_articles_against_all_windows_of_a_host(spark, monkeypatch, crowd):
    """As above, of pages with articles: what stands outside of them is repeated only if it is so outside."""
    monkeypatch.setattr(html, "MOST_CLASSES", crowd)
    monkeypatch.setattr(html, "MOST_TOKENS", 90)
    rng = np.random.default_rng(13)
    pool = [words(rng, 3) for _ in range(12)]
    some = lambda n: "".join(f"<p>{pool[k]}</p>" for k in rng.integers(0, 12, n))
    rows = [(i, "http://x.org/" if i % 5 else f"http://y{i}.org/", f"{some(4)}<article>{some(6)}</article>{some(3)}" if i % 2 else some(8)) for i in range(90)]
    streams, pages = {}, defaultdict(lambda: (set(), set()))
    for i, url, page in rows:
        found = html.settled(html.blocks(page))
        s = html.stream(found)
        inside = [sure for text, _, sure in found for _ in range(text.count(" ") + 2)]
        streams[i] = (url, s, inside)
        for k in range(len(s) - html.WINDOW + 1):
            anywhere, outside = pages[url, tuple(s[k : k + html.WINDOW])]
            anywhere.add(tuple(s))
            if not all(inside[k : k + html.WINDOW]):
                outside.add(tuple(s))
    want = {}
    for i, (url, s, inside) in streams.items():
        hit = set()
        for k in range(len(s) - html.WINDOW + 1):
            anywhere, outside = pages[url, tuple(s[k : k + html.WINDOW])]
            if len(anywhere if all(inside[k : k + html.WINDOW]) else outside) > 1:
                hit |= set(range(k, k + html.WINDOW))
        want[i] = sum(s[k] != "\n" for k in hit)
    got = {r["page_id"]: r["n_repeated"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and any(v for k, v in want.items() if k % 2)


def test_packed_names():
    rng = np.random.default_rng(15)
    for names in ([5], [0, 1, 2**32], [0, 2**32 + 1], [3, 2**43], rng.integers(0, 2**44, 5_000)):
        names = np.unique(np.array(names, np.uint64))
        assert (html._unpacked_names(html._packed_names(names)) == names).all()
