"""Wrappers: layouts, long lists, order, markup, and alignment against a matcher."""

import random
import re
import time
from html import unescape

import pytest

from tidemark.llm import wrapper


@pytest.mark.parametrize("start", ['div class="content with-sidebar"', 'div class="no-sidebar"', 'article class="post comments-open category-social"', 'div class="content social"', 'section id="page-share"'])
def test_main_text_in_an_element_with_an_aside_word(spark, start):
    page = f'<html><body><div class="menu">Home</div><{start}><h1>Title</h1><p>%s</p><div class="share">Share this</div></{start.split()[0]}><section class="comments"><article class="comment"><p>bad</p></article></section></body></html>'
    rows = [(i, f"http://a.com/{i}", page % f"the text of page {i} with some more words in it") for i in range(3)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in got} == {i: f"Title\n\nthe text of page {i} with some more words in it" for i in range(3)}


def test_long_comments_stay_aside(spark):
    page = '<article><h1>T</h1><p>short text</p></article><div class="comments"><article class="comment"><p>' + "comment " * 90 + "</p></article></div>"
    assert wrapper.main_text(spark.createDataFrame([("http://a.com", page)], "url string, html string")).first().main_text == "T\n\nshort text"
    assert wrapper.is_aside(wrapper.signature("div", 'class="sidebar-left"')) and wrapper.is_aside(wrapper.signature("div", 'class="post-comments"'))
    assert wrapper.is_aside(wrapper.signature("div", 'id="leftSidebar"')) and not wrapper.is_aside(wrapper.signature("div", 'class="content has-left-sidebar"'))


def test_align_of_long_lists_leaves_nothing_out(spark):
    r = random.Random(3)
    leaf = lambda k: [k, "1", 1, 0, frozenset(), []]
    for n, kinds in ((900, 10**9), (900, 5), (1300, 400)):
        x, y = ([f"p.{r.randrange(kinds)}" for _ in range(n)] for _ in range(2))
        x[100:120] = y[300:320] = [f"h2.same{k}" for k in range(20)]
        pairs = wrapper.matches(x, y)
        assert len(pairs) >= 20 and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        got = wrapper.align([leaf(k) for k in x], [leaf(k) for k in y])
        count = lambda nodes: sum(k[2] + count(k[5]) for k in nodes)
        assert count(got) == 2 * n
    page = '<div class="site">%s<article class="post cat%s"><h1>T</h1><p>main %d</p></article><article class="teaser"><p>see also</p></article></div>'
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    rows = [(i, "http://a.com", page % ("", word(i), i)) for i in range(500)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert all(f"main {x.page_id}" in x.main_text for x in got)


R = random.Random(9)


def random_page(r):
    """A page of one site: optional parts, repeats and nested lists, with texts of its own."""
    word = lambda: " ".join(r.choices("lorem ipsum dolor sit amet consetetur sadipscing".split(), k=r.randint(1, 6)))
    items = "".join(f"<li>{word()}{'<ul><li>x<li>y</ul>' if r.random() < 0.3 else ''}" for _ in range(r.randint(0, 4)))
    parts = "".join(r.choice((f"<h2>{word()}</h2><p>{word()}</p>", f"<p>{word()}</p>", "<hr>", f"<blockquote><p>{word()}</p></blockquote>")) for _ in range(r.randint(1, 6)))
    side = f'<div class="sidebar"><p>{word()}</p></div>' if r.random() < 0.5 else ""
    return f'<body><nav><ul><li><a>Home</a><li><a>About</a></ul></nav>{side}<article><h1>{word()}</h1>{parts}<ul>{items}</ul><p class="terms">Read our terms</p></article></body>'


def pattern(node):
    """The wrapper as a regular expression over the tags of a page."""
    kids = "".join(map(pattern, node[wrapper.KIDS]))
    if node[wrapper.SIG] == wrapper.TEXT:
        inner = "t;"
    elif node[wrapper.SIG] in ("", *wrapper.GROUPS):
        inner = kids
    else:
        inner = re.escape(f"<{node[wrapper.SIG]}>") + kids + re.escape(f"</{node[wrapper.SIG]}>")
    return f"(?:{inner}){node[wrapper.OCC] if node[wrapper.OCC] != '1' else ''}"


def tags(html):
    out = []
    for kind, value, _ in wrapper.events(html):
        out.append("t;" if kind == "t" and value.strip() else "" if kind == "t" else f"<{value}>" if kind == "+" else f"</{value}>")
    return re.sub("(?:t;)+", "t;", "".join(out))


def test_every_page_matches_the_merged_wrapper():
    for _ in range(40):
        pages = [random_page(R) for _ in range(R.randint(2, 7))]
        skeletons = [wrapper.skeleton(wrapper.events(p)) for p in pages]
        root = skeletons[0]
        for s in skeletons[1:]:
            root = wrapper.merge(root, s)
        for p, s in zip(pages, skeletons, strict=True):
            assert re.fullmatch(pattern(s), tags(p)), p
            assert re.fullmatch(pattern(root), tags(p)), wrapper.expression(root)
        total = lambda n, k: n[k] + sum(total(x, k) for x in n[wrapper.KIDS])
        assert total(root, wrapper.CHARS) == sum(total(s, wrapper.CHARS) for s in skeletons)
        assert wrapper.flat(wrapper.tree(*wrapper.flat(root))) == wrapper.flat(root)


def varied_page(r, n=30):
    """A page with a shape of its own: random blocks in random order, some inside each other."""
    kinds = ("<p>%s</p>", "<h2>%s</h2>", "<ul><li>%s</ul>", "<blockquote>%s</blockquote>", "<pre>%s</pre>", "<figure><figcaption>%s</figcaption></figure>", "<div class='box'><p>%s</p></div>", "<table><tr><td>%s</table>")
    blocks = "".join(r.choice(kinds) % f"text{r.randrange(99)}" for _ in range(n))
    return f"<html><body><div class='menu'><a>Home</a></div><div class='content'><h1>Title</h1>{blocks}</div><div class='extra'><p>short</p></div></body></html>"


def test_gathered_children_take_every_page_and_leave_the_region(monkeypatch):
    r = random.Random(21)
    for make in (random_page, varied_page):
        pages = [make(r) for _ in range(12)]
        skeletons = [wrapper.skeleton(wrapper.events(p)) for p in pages]
        regions = set()
        for wide in (0, 3, 64, 10**9):
            monkeypatch.setattr(wrapper, "WIDE", wide)
            for order in (skeletons, skeletons[::-1]):
                root = order[0]
                for s in order[1:]:
                    root = wrapper.merge(root, s)
                regions.add(tuple(wrapper.main_region(root)))
                total = lambda n, k: n[k] + sum(total(x, k) for x in n[wrapper.KIDS])
                assert total(root, wrapper.CHARS) == sum(total(s, wrapper.CHARS) for s in skeletons)
                assert wrapper.flat(wrapper.tree(*wrapper.flat(root))) == wrapper.flat(root)
                if wide == 3:
                    assert ")*" in wrapper.expression(root)
                    assert all(re.fullmatch(pattern(root), tags(p)) for p in pages)
        assert len(regions) == 1


def test_a_shape_per_page_takes_linear_time(spark):
    r = random.Random(22)
    skeletons = [wrapper.skeleton(wrapper.events(varied_page(r))) for _ in range(1600)]
    took = {}
    for n in (400, 1600):
        start, root = time.perf_counter(), skeletons[0]
        for s in skeletons[1:n]:
            root = wrapper.merge(root, s)
        took[n] = time.perf_counter() - start
    assert took[1600] < 8 * took[400] and len(wrapper.flat(root)[1]) < 200, took
    pages = [(i, "http://hot.com/", varied_page(r)) for i in range(300)]
    got = wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = {i: ["Title", *re.findall(r"text[0-9]+", h)] for i, _, h in pages}
    assert {x.page_id: x.main_text.split("\n\n") for x in got} == want


def test_wrappers_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://h{i % 3}.com/{i}", random_page(R)) for i in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = set()
    for n, order in ((1, "page_id"), (7, "html"), (30, "page_id")):
        frame = table.orderBy(order).repartition(n)
        wrappers = wrapper.infer(frame.withColumn("host", wrapper.host_of(frame.url)), "host", "html").collect()
        texts = wrapper.main_text(frame).select("page_id", "main_text").collect()
        assert sum(r.pages for r in wrappers) == len(rows) and len(wrappers) == 3
        got.add((tuple(sorted(map(str, wrappers))), tuple(sorted(map(tuple, texts)))))
    assert len(got) == 1
    texts = dict(next(iter(got))[1])
    assert not any("Home" in t for t in texts.values()) and all(texts.values())


def test_shared_texts_are_the_articles_at_any_number_of_pages(spark):
    page = "<article><h1>Title</h1><h2>Summary</h2><p>%s</p><h2>Details</h2><p>more of it</p></article>"
    for n in (1, 4, 5, 30):
        rows = [(i, "http://a.com", page % f"own words of page {i}") for i in range(n)]
        got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.main_text for r in got} == {f"Title\n\nSummary\n\nown words of page {i}\n\nDetails\n\nmore of it" for i in range(n)}


def alone(html):
    stream = wrapper.events(html)
    return wrapper.extract(stream, wrapper.main_region(wrapper.skeleton(stream)))


@pytest.mark.parametrize(
    "inner",
    [
        'one <svg class="i"/>two',
        "one <svg><path d='x'/><svg><g/></svg><title>no</title><text>no</text></svg>two",
        "one <!-->two",
        "one <!--->two",
        "one <!-- no --!>two",
        "one <b title=don't>two</b>",
        'one <b class="x"">two</b>',
        "one <script>no</script><style>no</style>two",
        "one <noscript>two",
    ],
)
def test_markup_as_html_says(inner):
    assert alone(f"<article><h1>T</h1><p>{inner}</p><p>it's three</p></article>") == "T\n\none two\n\nit's three"


def test_unclosed_svg_ends_at_a_block():
    assert alone("<article><h1>T</h1><p>one <svg><path d='x'><text>no</text><p>two</article>") == "T\n\none\n\ntwo"


def test_a_form_around_the_page_is_no_aside():
    article = "<article><h1>T</h1><p>one two three four five</p></article>"
    page = '<body><form id="all"><nav><a href="x">menu</a> and more</nav>%s<div class="footer">foot</div></form></body>'
    assert alone(page % article) == "T\n\none two three four five"
    assert alone(page % "<div><p>no title but one two three four five six</p></div>") == "no title but one two three four five six"
    small = "<form><label>name</label> <input> send this form</form>"
    assert alone(f"<body>{small}{article}</body>") == alone(f"<body>{article}{small}</body>") == "T\n\none two three four five"


def test_scope_of_p_and_lists():
    assert alone("<article><p>a" + "<label>" * 30 + "<div>b</div></article>") == "a\n\nb"
    assert alone("<article><p>a<table><tr><td>b<p>c<td>d</table>e</article>") == "a\n\nb\n\nc\n\nd\n\ne"


def test_broken_markup_takes_linear_time():
    start = time.perf_counter()
    for unit in ("<a", "<a ", "<a b='", '<a b="x', "<!--", "<svg>", "<svg/>"):
        wrapper.events(unit * (64_000 // len(unit)))
    wrapper.events("<div>" * 8_000 + "<dd>x" * 8_000)
    wrapper.events("<p><button>" + "<div>" * 8_000)
    assert time.perf_counter() - start < 5


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "<article><p>deep text</p></article>" + "</div>" * 5000
    rows = [(1, "http://a.com", deep), (2, "http://a.com", "<div>" * 30_000), (3, "http://b.com", "<ul>" + "<li>x" * 20_000), (4, None, "<p>" * 9_000 + "z")]
    table = spark.createDataFrame([(*r, "a", 2) for r in rows], "page_id long, url string, html string, _region string, _host int")
    got = wrapper.main_text(table)
    assert got.columns == [*table.columns, "main_text"]
    got = {r.page_id: r.main_text for r in got.collect()}
    assert got[1] == "deep text" and got[2] == "" and got[3].count("x") == 20_000 and got[4] == "z"


def test_a_hot_host(spark):
    rows = [(i, "http://hot.com/" if i % 3 else f"http://h{i}.com/", f"<main><p>text {i}</p></main>") for i in range(900)]
    got = {r.page_id: r.main_text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(900)}


def test_given_pages_against_brute_force(spark):
    """The given pages have one layout: all of the article, its blocks cut at block tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.main_text for r in wrapper.main_text(pages.select("page_id", "url", "html")).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html or "", re.S)
        blocks = re.split("</?(?:h1|p|ul|li)>", inner[1] if inner else "")
        lines = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(x for x in lines if x), r.page_id
    assert len(got) == pages.count()


def test_subjects_are_no_asides():
    aside = lambda attrs: wrapper.is_aside(wrapper.signature("div", attrs))
    assert not any(map(aside, ('class="social-studies lesson"', 'class="legal-history"', 'id="menuPlanning"', 'class="notice-of-hearing article"')))
    assert all(map(aside, ('class="social-links"', 'class="related-posts"', 'class="share"', 'id="siteNotice"', 'class="search-form"', 'class="weather-widget"', 'class="main-menu"', 'class="post social"')))
