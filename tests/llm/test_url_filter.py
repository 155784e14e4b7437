import random
import re

from pyspark.sql import functions as F

from corpusforge.llm.components import connected_components
from corpusforge.llm.queries import URL_RULES
from corpusforge.llm.url_filter import html_links, judge_urls, resolved

NO_LINKS = "a string, b string"


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_components_match_brute_force(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(300)] + [(9, 9), (1, None)]
    found = dict(connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_match_brute_force(spark):
    draw = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "myexample.com", "x.net", "NET", "a.Example.COM", "", "example.com:80", "u@x.net", "..net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "/de/?q=/en/", "#/en/", "/EN/", "//en/"]
    urls = [draw.choice(["http://", "https://", "", "ftp://", "://"]) + draw.choice(hosts) + draw.choice(paths) + draw.choice(["", "?a=b", "#c", "?x#y://z/es/"]) for _ in range(400)] + [None, "", "no url", "a\nb://x.net/es/"]
    rules = [*URL_RULES, ("example.com", "/en/x", "block"), ("example.com", "/en/x", "allow"), ("net", "/", "block")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark, pages, given, spark.createDataFrame([], NO_LINKS)).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_blocks_spread_over_redirects_and_canonical_links(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://one.org/a#part", '<LINK href="http://bad.net/es/1" rel=canonical>'),
            (2, "http://two.org/b", '<meta http-equiv="refresh" content="0; url=http://one.org/a">'),
            (2, "http://two.org/b", None),
            (3, "http://three.org/c", '<link rel="canonical" href="/d">'),
            (4, "http://three.org/d?x=1&y=2", "no link"),
            (5, "http://five.org/", '<link rel="canonical" href="http://good.com/es/">'),
            (6, "http://six.org/", '<link rel="canonical" href="http://five.org/"><meta http-equiv=refresh content="5;URL=http://bad.net/fr/">'),
            (7, "http://www.ok.com/x", '<link rel="canonical" href="http://bad.net/es/1">'),
            (None, None, None),
        ],
        "page_id long, url string, html string",
    )
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = judge_urls(spark, pages, rules, html_links(pages).union(spark.createDataFrame([("http://three.org/d", "http://eight.org/"), (None, "x")], NO_LINKS))).collect()
    got = sorted(((r.page_id, r.rule, r.verdict) for r in out), key=str)
    # 7 is allowed by its own rule, which frees its whole class: 1, 2 and 7 share the blocked address
    assert got == sorted([(1, None, "allow"), (2, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, "com/", "allow"), (None, None, "allow")], key=str)
    without = pages.where("page_id is null or page_id <> 7")
    out = judge_urls(spark, without, rules, html_links(without)).collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", None: "allow"}
    assert judge_urls(spark, pages.limit(0), rules, html_links(pages.limit(0))).count() == 0


def test_references_resolve_as_the_standard_says(spark):
    """RFC 3986, 5.4, with ``http`` and without fragments."""
    page = "http://a/b/c/d;p?q"
    want = {
        "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "#s": "/b/c/d;p?q", "g#s": "/b/c/g", "g?y#s": "/b/c/g?y", ";x": "/b/c/;x",
        "": "/b/c/d;p?q", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../g": "/g", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.",
        "..g": "/b/c/..g", "./../g": "/b/g", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/../y": "/b/c/y", "g?y/../x": "/b/c/g?y/../x", "g#s/../x": "/b/c/g", "p?u=http://x/": "/b/c/p?u=http://x/",
    }
    whole = {"//g": "http://g", "http://h/x/../y?z": "http://h/y?z", "mailto:a@b": None, **{t: "http://a" + p for t, p in want.items()}}
    rows = [(page, t) for t in whole] + [("http://e.org", "x"), ("http://e.org?q", "x"), ("no url", "x")]
    got = spark.createDataFrame(rows, "a string, t string").select("a", "t", resolved(F.col("a"), F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got if r.a == page} == whole
    assert {r.a: r.u for r in got if r.a != page} == {"http://e.org": "http://e.org/x", "http://e.org?q": "http://e.org/x", "no url": None}


def test_relative_and_repeated_links(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://one.org/x/y/a?k=1", '<link rel=canonical href="../b">'),
            (2, "http://one.org/x/b", '<meta http-equiv="refresh" content="0; url=?id=1&amp;n=2"><meta http-equiv=refresh content="3;url=page.html">'),
            (3, "http://one.org/x/page.html", '<link rel="canonical" href="http://plain.org/"><link rel="canonical" href="http://bad.net/es/1">'),
            (4, "http://one.org/x/b?id=1&n=2", None),
            (5, "http://one.org/x/other", '<link rel="canonical" href="mailto:x@bad.net">'),
            (7, "http://plain.org/", ""),
        ],
        "page_id long, url string, html string",
    )
    links = html_links(pages)
    assert {tuple(r) for r in links.collect()} == {
        ("http://one.org/x/y/a?k=1", "http://one.org/x/b"), ("http://one.org/x/b", "http://one.org/x/b?id=1&n=2"), ("http://one.org/x/b", "http://one.org/x/page.html"),
        ("http://one.org/x/page.html", "http://plain.org/"), ("http://one.org/x/page.html", "http://bad.net/es/1"),
    }
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    verdicts = {r.page_id: r.verdict for r in judge_urls(spark, pages, rules, links).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 7: "block"}


def test_query_matches_its_sql(spark):
    import duckdb

    from corpusforge.llm.queries import QUERIES, URL_FILTER_SQL

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op9_url_filter"](spark, folder).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [x for x in got if x[3]] and got == sorted(con.execute(URL_FILTER_SQL).fetchall())


def test_sql_follows_the_same_links(spark, tmp_path):
    """The query and its SQL on pages that hold absolute, rooted, relative, repeated and odd references."""
    import duckdb

    from corpusforge.llm.queries import QUERIES, URL_FILTER_SQL

    hrefs = ["g", "./g", "g/", "/g", "//h.org/x/../y?z", "?y", "g?y", "#s", "g#s", ";x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h",
             "mailto:a@b", "http://bad.net/es/1", "HTTPS://Www.Ok.com/q/../x#f", "p?u=http://x/", "a&amp;b", "http://e.net/fr/x?y=1", "x.net/es/"]
    rows = [(k, f"http://one{k % 4}.org/b/c/d;p?q{k % 3}", f'<link rel="canonical" href="{h}"><p>x</p><meta http-equiv=refresh content="3; url={hrefs[(k * 7 + 3) % len(hrefs)]}">') for k, h in enumerate(hrefs)]
    rows += [(100 + k, u, None) for k, u in enumerate(["http://one0.org/b/c/g", "http://one1.org/b/g", "http://h.org/y?z", "http://one2.org/", "no url", None, "http://plain.org"])]
    rows += [(200, "http://plain.org", '<LINK REL=canonical HREF=x><link rel=canonical href=http://bad.net/es/1>'), (201, "http://plain.org/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted((tuple(r) for r in QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(con.execute(URL_FILTER_SQL).fetchall(), key=str)
    assert got == want and sum(r[4] == "block" for r in got) > 10
