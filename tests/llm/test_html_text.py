import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import html_text


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_is_a_longest_common_subsequence():
    for seed in range(400):
        rng = random.Random(seed)
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(40))] for _ in range(2))
        got = html_text.common(a, b)
        rest = iter(b)
        assert len(got) == plain_lcs(a, b) and all(any(y == a[i] for y in rest) for i in sorted(got))


def text(page):
    blocks = html_text.blocks_of(page)
    return "\n".join(t for (t, _), m in zip(blocks, html_text.candidates(blocks), strict=True) if m)


def test_markup_rules():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class="ad box">buy</div>
    <article><h1>A &amp; B&nbsp;&#39;c&#39;</h1><p>one<br>two <b>th</b>ree<p>four <script>var t = "</p>";</script>five<!-- no --><aside>side</aside><div id="comments"><p>me too</div>
    <form>mail<input></form><table><tr><td>x</td><td>y</td></tr></table><p class="cookie-notice">ok?<p>six</article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "A & B 'c'\none two three\nfour five\nx y\nsix"
    assert text("<p>a<div hidden>x</div><div style='display: none'>y</div><div role=navigation>z</div><span>b</span> c") == "a\nb c"
    assert text(None) == text("") == "" and text("plain  text") == "plain text" and text("<nav>only") == ""
    assert text("<article><p>a &amp;amp; b</p></article><div>x</div>") == "a &amp; b"
    kinds = dict(html_text.blocks_of(page))
    assert kinds["Home"] == kinds["buy"] == kinds["side"] == kinds["me too"] == "part" and kinds["six"] == "main"


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<![foo[bar]]>b", "ab"), ("a<![ x", "a<![ x"), ("a<![CDATA[x]]>b<!doctype html><?php x?>c", "abc"), ("1 < 2 <3 & 4 &lt; 5 </ x>6", "1 < 2 <3 & 4 < 5 6"),
        ("<article><div class=ad>Buy now<p>Text one</p><p>two</article>", "Text one\ntwo"), ("<body><div class='ad'>Buy<h1>Title</h1>more", "Title\nmore"),
        ("<p class='search-results'>kept</p>", "kept"), ("<div class=search>x</div>y", "y"), ("<div class='has-sidebar'><article>in</article></div>", "in"),
        ("<form id=page><h1>t</h1><article>in</article></form>", "in"), ("<p title=it's>a</p><p title=\"x>b", "a\nb"), ("<!-- never ends <p>a</p>b", "a\nb"), ("<!-->a<!--->b<!-- x --!>c -->d", "abd"),
        ("<script>var x = '<p>no</p>'", ""), ("<textarea>no<p>no</textarea>yes", "yes"), ("<p><span class=share>no</span>yes</p>", "yes"), ("x</p>y</br>z", "x\ny z"), ("<article class=comment>no</article>yes", "yes"),
    ],
)
def test_broken_markup(page, want):
    assert text(page) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<!", "<![", "]]>", "<!--", "-->", "</", "<p>", "<div class=ad>", "</div>", "<article>", "</article>", "<script>", "</script>", "'", '"', "=", "&", "&amp;", "&#x110000;", "&#0;", "a", " ", "<a b='", "<?", "\ud800", "\x00"]), max_size=30).map("".join))
def test_any_text_has_blocks(page):
    assert all(t and t == " ".join(t.split()) and k in ("main", "plain", "part") for t, k in html_text.blocks_of(page))


def test_time_grows_with_the_length_only():
    for piece in ("<!--", "<a b='", "<script", "<![", "<div class=ad>", '<p x="', "<title>", "</", "<p>"):
        assert isinstance(html_text.blocks_of(piece * 20_000), list)


def brute(rows):
    """main_text of (page_id, url, html) rows by whole comparison."""
    hosts = {}
    for _, url, page in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        blocks = html_text.blocks_of(page)
        hosts.setdefault(host, {}).setdefault(tuple(blocks), set()).add(path)
    out = []
    for i, url, page in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
        blocks = html_text.blocks_of(page)
        contents = hosts[rest[:cut].lower()]
        own = min(contents[tuple(blocks)])
        paths = sorted({min(p) for p in contents.values()}, key=lambda p: p.encode())
        at = paths.index(own)
        near = [paths[k] for k in (at - 1, at + 1, at - 2, at + 2) if 0 <= k < len(paths)]
        pages = []
        for p in near:
            found = [c for c, ps in contents.items() if min(ps) == p]
            assert len(found) == 1
            pages.append((p, [t for t, _ in found[0]]))
        lines, may = [t for t, _ in blocks], html_text.candidates(blocks)
        inside = any(k == "main" for _, k in blocks)
        mine, gone = [n for n, m in enumerate(may) if m], set()
        if inside and len(pages) > 1:
            gone = set.intersection(*[html_text.common(lines, p) for _, p in pages]) & set(mine)
            words = lambda ns: sum(len(lines[n].split()) for n in ns)
            gone = gone if 2 * words(gone) < words(mine) else set()
        elif not inside and pages:
            start = lambda p: next((k for k, (x, y) in enumerate(zip(p, own, strict=False)) if x != y), min(len(p), len(own)))
            best = max(start(p) for p, _ in pages)
            gone = html_text.common(lines, next(k for p, k in pages if start(p) == best)) & set(mine)
        gone = gone if len(gone) < len(mine) else set()
        out.append((i, "\n".join(lines[n] for n in mine if n not in gone)))
    return sorted(out, key=str)


def site(seed, n=120):
    rng = random.Random(seed)
    rows, lines = [], [f"line {k}" for k in range(40)]
    for i in range(n):
        body = "".join(f"<p>{x}</p>" for x in rng.sample(lines, rng.randrange(1, 9)))
        frame = rng.choice([f"<div>Site menu</div>{body}<div>About us</div>", f"<nav>Site menu</nav><article><p>Read also</p>{body}</article>", f"<article>{body}<p>own {i}</p><p>Share this</p></article>"])
        rows.append((i, f"http://{'ABC'[i % 3]}.example/{rng.choice(['news', 'shop'])}/{i}", f"{frame}<p>unlike {i}</p>"))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in (0, 0, 5)] + [(n + 10, None, "<p>x</p>"), (n + 11, "http://a.example/z", None)]
    return rows


def test_same_as_whole_comparison_at_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_text, "TILE", 7)
    rows = site(1)
    want = brute(rows)
    for parts in (1, 8, 40):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        for broadcast in (0, 1000) if parts == 8 else (1000,):
            got = sorted(((r.page_id, r.main_text) for r in html_text.extract(pages, broadcast_contents=broadcast).collect()), key=str)
            assert got == want
    assert any("Share this" not in t and "own" in t for _, t in want) or any("Site menu" not in t for _, t in want)


def test_lines_shared_with_the_nearest_page_go(spark):
    nav = "<div>Home</div><div>About us</div>"
    rows = [(i, f"http://h.example/{'news' if i < 6 else 'shop'}/{i}", f"{nav}<div>own {i}</div><div>more {i}</div>", "x", "y") for i in range(10)]
    rows += [(3, rows[3][1], rows[3][2], "x", "y")] * 3  # copies lose what the first loses
    rows += [(20, "http://alone.example/a", nav, "x", "y"), (21, None, None, "x", "y"), (22, "http://h.example/art", f"<article><p>Home</p></article>{nav}", "x", "y"), (20, "http://alone.example/a", nav, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, __x0 string")
    got = html_text.extract(pages)
    found = {}
    for r in got.collect():
        assert found.setdefault(r.page_id, r.main_text) == r.main_text
    assert got.columns == ["page_id", "url", "__x0", "main_text", "main_chars", "main_deleted"] and got.count() == len(rows)
    assert all(found[i] == f"own {i}\nmore {i}" for i in range(10))
    assert found[20] == "Home\nAbout us" and found[21] == "" and found[22] == "Home"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_article_lines_need_all_neighbours(spark):
    body = lambda i: "".join(f"<p>word {i} {k} of a long article</p>" for k in range(4))
    rows = [(i, f"http://h.example/{i}", f"<article><p>Follow us</p>{body(i)}{'<p>a quotation</p>' if i < 2 else ''}</article>") for i in range(8)]
    rows += [(10 + i, f"http://c.example/{i}", f"<article>{body(0)}<p>edition {i}</p></article>") for i in range(5)]  # near copies
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Follow us" not in found[i].main_text and found[i].main_deleted == 1 for i in range(8))
    assert "a quotation" in found[0].main_text and all(found[10 + i].main_text.count("\n") == 4 for i in range(5))


def test_long_pages(spark):
    long = "".join(f"<p>paragraph {k}</p>" for k in range(100_000))
    pages = spark.createDataFrame([(1, "http://h.example/a", long), (2, "http://h.example/b", f"<div>x</div>{long}")], "page_id long, url string, html string")
    got = {r.page_id: r.main_chars for r in html_text.extract(pages).collect()}
    assert got[1] > 1_000_000 and got[2] == 1


@pytest.mark.parametrize("name, kept", [("market-share", True), ("ad-hoc", True), ("related-work", True), ("comment-on-results", True), ("ad", False), ("ad-box-2", False), ("share-buttons", False), ("related-posts", False), ("cookie-info-x", False), ("my-newsletter", False), ("x ad", False)])
def test_words_that_name_other_things_too(name, kept):
    inside = text(f'<article><p>one</p><div class="{name}">two</div></article>')
    assert inside == ("one\ntwo" if kept else "one")
    assert text(f'<p>one</p><div id="{name.split()[-1]}">two</div>') == "one"  # outside of an article such a word is enough


def test_formulas_are_text():
    assert text("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>") == "if x=2 then"
