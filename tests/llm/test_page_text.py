import html
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import page_text
from corpusforge.llm.page_text import FRAME, MAIN, OTHER, blocks, common, main_text


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 6])
def test_common_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(page_text, "TABLE_BITS", bits)
    draw = random.Random(4)
    for _ in range(2000):
        a, b = ([draw.choice("abcdefg") for _ in range(draw.randint(0, 14))] for _ in range(2))
        found = common(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert len(found) == longest(a, b)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, []),
        ("", []),
        ("<p>a<b>b</b>  c<br>d<p class=notice>x<p>e", [("ab c", OTHER), ("d", OTHER), ("x", FRAME), ("e", OTHER)]),
        ("<div class='ad'>x<div>y</div></div>z", [("x", FRAME), ("y", FRAME), ("z", OTHER)]),
        ("<body>a &amp; b &lt;i&gt; &#233; &amp<script>if(a<b)</script>y", [("a & b <i> é &", OTHER), ("y", OTHER)]),
        ("<!-- <p>x --><p>y<!-- z", [("y", OTHER)]),
        ("<article><header><h1>t</h1></header><div id='comments'>c</div>m<footer>f</footer></article>out", [("t", MAIN), ("c", FRAME), ("m", MAIN), ("f", FRAME), ("out", OTHER)]),
        ("<span class='ad'>x</span>y<form>f<input>g</form>h", [("x", FRAME), ("y", OTHER), ("f", FRAME), ("g", FRAME), ("h", OTHER)]),
        ("a < b and c > d", [("a < b and c > d", OTHER)]),
        ("<div title='a>b'>q</div></div></p>r", [("q", OTHER), ("r", OTHER)]),
        ("<a href=\"x\"\">link</a>", [("link", OTHER)]),
        ("<div title=\"a>bad</div>", [("bad", OTHER)]),
        ("<div \"title=a>one</div><p class='x' \"'>two", [("one", OTHER), ("two", OTHER)]),
        ("<p data-x=a\"b>q</p>", [("q", OTHER)]),
        ("<div id='content-sidebar-wrap'><article>a</article><div class=sidebar>s</div></div>", [("a", MAIN), ("s", FRAME)]),
        ("<div class='layout has-sidebar'><main>a</main><aside>s</aside></div>", [("a", MAIN), ("s", FRAME)]),
        ("<div class='post no-comments'><p>long text of the post<p>more of it</div><div class=footer>f</div>", [("long text of the post", OTHER), ("more of it", OTHER), ("f", FRAME)]),
        ("<div class='navbar-fixed page'><p>text of the page</p></div>", [("text of the page", OTHER)]),
        ("<div class='top-menu-bar'>home</div><p>the only text of this page</p>", [("home", FRAME), ("the only text of this page", OTHER)]),
        ("<article>post</article><article class='comment'>c</article><article class='ad'>x</article>", [("post", MAIN), ("c", FRAME), ("x", FRAME)]),
        ("<article class='post share-enabled'>a</article><article class='post has-comments'>b</article>", [("a", MAIN), ("b", MAIN)]),
        ("<article class='social'>the story</article><nav>n</nav>", [("the story", MAIN), ("n", FRAME)]),
        ("<div class='page sidebar'><main>a</main></div>", [("a", MAIN)]),
        ("<p>short</p><div id=comments><article>first comment, which is long</article></div>", [("short", OTHER), ("first comment, which is long", FRAME)]),
        ("<div class='social'>all there is</div>", [("all there is", OTHER)]),
    ],
)
def test_blocks(source, want):
    assert blocks(source) == want


def test_long_and_broken_pages_take_linear_time():
    for source in ("<div class=ad>" * 3000 + "x" * 10, "<a b=\"c>" * 30000, "<a b='c>d" * 30001, "<p>x" * 100000, "<div>" * 50000 + "x", "<" * 50000, "&" * 200000, "<script>" * 20000, "x" * 3000000):
        blocks(source)
    a = [str(k) for k in range(4000)]
    assert len(common(a, a[::2])) == 2000


def test_frame_is_found_by_the_neighbour(spark):
    """Pages without any marks: what neighbours share goes, what only one has stays; copies do not delete each other."""

    def page(*lines):
        return "".join(f"<div>{x}</div>" for x in lines)

    rows = [
        (1, "http://a.example/x/1", page("Menu", "Home", "first story", "more of it", "All rights reserved")),
        (2, "http://a.example/x/2", page("Menu", "Home", "second story", "All rights reserved")),
        (2, "http://a.example/x/2", page("Menu", "Home", "second story", "All rights reserved")),
        (3, "http://b.example/x/1", page("Menu", "alone on its host")),
        (4, None, None),
        (None, "http://c.example", "<article>kept by both</article>"),
        (5, "http://c.example/y", "<nav>n</nav><article>kept by both</article><p>not main"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_id", F.lit(2))
    out = main_text(spark, pages).collect()
    got = sorted(((r.page_id, r.text) for r in out), key=str)
    story = "second story"
    assert got == sorted([(1, "first story\nmore of it"), (2, story), (2, story), (3, "Menu\nalone on its host"), (4, ""), (None, "kept by both"), (5, "kept by both")], key=str)
    assert all(r.n_chars == len(r.text) for r in out)
    assert main_text(spark, pages.limit(0)).count() == 0


def test_cuts_change_no_text(spark):
    """A host of 1,500 pages without article or main: every page is set against its nearest URL, over all cuts and runs of copies."""
    rows = []
    for section in range(300):
        menu = "".join(f"<li>section {section} item {k}</li>" for k in range(3))
        for k in range(5):
            rows.append((5 * section + k, f"http://hot.example/s{section:03d}/p{k}", f"<ul><li>Home</li>{menu}</ul><p>story {section} {k}</p><p>All rights reserved</p>"))
    rows += [(10000 + k, "http://hot.example/s150/p2x", "<p>Home</p><p>copied</p>") for k in range(400)]
    rows += [(20000 + k, f"http://h{k}.example/", f"<p>alone {k}</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(spark, pages).collect()}
    assert len(got) == len(rows)

    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[1], r[0]))
    lines = [[x for x, _ in blocks(r[2])] for r in order]
    for k, (i, address, _) in enumerate(order):
        host, path = address.split("/")[2], "/" + address.split("/", 3)[3]
        near = []
        for steps in (range(k - 1, -1, -1), range(k + 1, len(order))):
            j = next((j for j in steps if lines[j] != lines[k] or order[j][1].split("/")[2] != host), None)
            if j is not None and order[j][1].split("/")[2] == host:
                near.append(j)
        near.sort(key=lambda j: -page_text._agreeing("/" + order[j][1].split("/", 3)[3], path))
        shared = {a for a, _ in common(lines[k], lines[near[0]])} if near else set()
        assert got[i].text == "\n".join(x for n, x in enumerate(lines[k]) if n not in shared)
        assert got[i].n_shared == len(shared)
    assert all(got[5 * s + k].text == f"story {s} {k}" for s in range(300) if s != 150 for k in range(5))


def test_query_gives_every_article_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text(spark, pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        lines = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner))
        assert got[r.page_id] == "\n".join(x for x in lines if x)
