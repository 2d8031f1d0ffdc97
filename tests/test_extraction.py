import zlib

import pytest
from pyspark.sql import functions as F

from lingoscope.functions import bands, headers, html, urls
from lingoscope.functions.locale import answers, locale_from_path
from lingoscope.functions.urls import ancestors, in_scope, page_url, path_of, resolve
from lingoscope.sources import robots, sitemap
from lingoscope.sources.pages import crawled, redirect_routes

HTML = """<!DOCTYPE html><html><head><title> A &amp; <b>B</b> &copy; </title><meta name="Description" content="first"><meta name=description content="second">
<link rel="canonical" href="/c/"><link rel="alternate" hreflang="DE" href="/de/"><link rel="alternate" hreflang="de" href="/de2"><link rel="alternate" hreflang="x-default" href="/">
<meta name="robots" content="NoIndex, follow,noindex"><meta name="bingbot" content="none"></head>
<body><nav><a href="mailto:x@y.z">m</a><a class="q" href='/a/?x#y'>a</a><a href="b">b</a><a href="/a">again</a><a href=/unquoted>u</a></nav>
<main><h1>Head</h1><script>var x = "<p>no</p>"</script><p>Some&nbsp;TEXT &lt;here&gt; &bogus; {{ name }}</p><img src="/i/a.png" width=1 height=2><img src="/i/a.png"><img src="/i/b.jpg" data-width="1" height="1">
<picture><source type="image/webp" srcset="/i/c.webp 1x"><img src="/i/c.png"></picture><img src="data:image/png;base64,x"></main><code>[[x]]</code></body></html>"""


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("r", "HTTP://Shop.test:80/p/", 200, None, "text/html", {"x-robots-tag": "none", "X-Frame-Options": "DENY", "other": "1"}, HTML), ("r", "http://shop.test/x", 200, None, "application/pdf", {}, None)]
    df = spark.createDataFrame(rows, "run_id string, url string, http_status int, fetch_error string, content_type string, headers map<string,string>, html string")
    return {r["url"]: r for r in crawled(df).collect()}


def test_facts_of_a_page(facts):
    r = facts["http://shop.test/p"]
    assert r["hreflang"] == {"de": "http://shop.test/de2", "x-default": "http://shop.test/"}
    assert r["links"] == ["http://shop.test/a", "http://shop.test/b"]
    m = r["metadata"]
    assert (m["title"], m["description"], m["canonicals"]) == ("A & B &copy;", "first", ["http://shop.test/c"])
    assert [tuple(x) for x in m["robots"]] == [(None, ["noindex", "follow"]), ("bingbot", ["none"])]
    c = r["content"]
    assert c["isolated"] and c["text_digest"] is None and c["markers"] == ["unrendered_expression"]
    assert (c["blocks"]["heading"], c["blocks"]["form"], c["blocks"]["media"]) == (True, False, True)
    i = r["images"]
    assert (i["total"], i["undimensioned"], i["legacy"]) == (3, 1, 2)
    assert i["undimensioned_urls"] == ["http://shop.test/i/c.png"] and i["legacy_urls"] == ["http://shop.test/i/a.png", "http://shop.test/i/b.jpg"]
    assert r["security_headers"] == {"x-frame-options": "DENY"}


def test_facts_of_something_else(facts):
    r = facts["http://shop.test/x"]
    assert r["content"]["is_html"] is False and r["images"] is None and r["links"] == []


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("HTTPS://A.com:443/x/?q#f", "https://a.com/x"), ("http://a.com", "http://a.com/"), ("http://a.com/", "http://a.com/"), ("ftp://a.com/x", None), ("/x", None)])
def test_page_url(spark, raw, want):
    assert one(spark, page_url(F.col("u")), u=raw) == want


def test_resolving_relative_addresses():
    base = "https://a.com/x/y"
    assert [resolve(u, base) for u in ("z", "../z/", "//b.com", "?q", "#f", "javascript:void(0)", "/ü b")] == ["https://a.com/x/z", "https://a.com/z", "https://b.com/", "https://a.com/x/y", "https://a.com/x/y", None, "https://a.com/%C3%BC%20b"]


def test_scope_locale_and_ancestors(spark):
    def scope(path, include, exclude):
        arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return spark.range(1).select(in_scope(F.lit(path), arr(include), arr(exclude)).alias("x")).first()["x"]

    assert [scope("/company", ["/company"], []), scope("/companywide", ["/company"], []), scope("/a", ["/"], []), scope("/private/x", [], ["/priv"]), scope("/x", [], [])] == [True, False, False, False, True]
    assert [one(spark, locale_from_path(F.col("p")), p=p) for p in ("/de/x", "/pt_BR/", "/zz/x", "/deutsch")] == ["de", "pt-br", None, None]
    assert [one(spark, answers(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("en-gb", "en"), ("en", "en-gb"), ("eng", "en"))] == [True, False, False]
    assert one(spark, ancestors(F.col("u")), u="https://a.com/b/c/d") == ["https://a.com/", "https://a.com/b", "https://a.com/b/c"]
    assert one(spark, path_of(F.col("u")), u="https://a.com") == "/"


def test_robots_header(spark):
    rows = one(spark, headers.robots_header(F.col("v")), v="noindex, googlebot: nofollow, max-snippet: 5, bingbot: none")
    assert [tuple(r) for r in rows] == [(None, "noindex"), ("googlebot", "nofollow"), ("googlebot", "max-snippet: 5"), ("bingbot", "none")]


BODY = """Disallow: /early
User-agent: a
User-agent: Googlebot # both
Disallow: /x
Allow: /x/y$
Disallow:
Sitemap: https://a.com/s.xml
User-agent: *
Disallow: /*.pdf$
Disallow: /q?z
"""


def test_robots(spark):
    bodies = spark.createDataFrame([("r", BODY)], "run_id string, body string")
    rules = robots.parse(bodies)
    got = [(r["user_agents"], r["kind"], r["pattern"], r["line_number"], r["evaluable"]) for r in rules.orderBy("line_number").collect()]
    assert got == [(["a", "googlebot"], "disallow", "/x", 4, True), (["a", "googlebot"], "allow", "/x/y$", 5, True), (["*"], "disallow", "/*.pdf$", 9, True), (["*"], "disallow", "/q?z", 10, False)]
    assert robots.sitemaps(bodies).first()["sitemap"] == "https://a.com/s.xml"
    paths = spark.createDataFrame([("r", p) for p in ("/x/z", "/x/y", "/x/yy", "/f.pdf", "/")], "run_id string, path string")
    verdict = lambda agent: {r["path"]: r["allowed"] for r in robots.verdicts(robots.group_for(rules, agent), paths).collect()}
    assert verdict("googlebot-news") == {"/x/z": False, "/x/y": True, "/x/yy": False, "/f.pdf": True, "/": True}
    assert verdict("other")["/f.pdf"] is False


def test_sitemaps(spark):
    text = '<urlset><url><loc> https://a.com/x?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://A.com/y/]]></loc></url><url><loc>/rel</loc></url></urlset>'
    packer = zlib.compressobj(wbits=31)
    zipped = packer.compress(text.encode()) + packer.flush()
    df = spark.createDataFrame([("r", bytearray(zipped)), ("s", bytearray(b"\x1f\x8bbroken")), ("t", bytearray(text.encode()))], "run_id string, body binary")
    texts = {r["run_id"]: r["text"] for r in df.select("run_id", sitemap.decoded("body").alias("text")).collect()}
    assert texts == {"r": text, "s": None, "t": text}
    rows = sitemap.parse(spark.createDataFrame([("r", text)], "run_id string, text string")).collect()
    assert [(r["raw"], r["url"]) for r in rows] == [("https://a.com/x?a=1&b=2", "https://a.com/x"), ("https://A.com/y/", "https://a.com/y"), ("/rel", None)]


def test_redirects(spark):
    hops = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "x", "y"), ("r", "y", "x")] + [("r", f"n{i}", f"n{i + 1}") for i in range(15)], "run_id string, src string, dst string")
    starts = spark.createDataFrame([("r", u) for u in ("a", "x", "c", "n0")], "run_id string, url string")
    got = {r["url"]: (r["final"], r["error"]) for r in redirect_routes(hops, starts).collect()}
    assert got == {"a": ("c", None), "x": (None, "Redirect loop."), "c": ("c", None), "n0": (None, "Too many redirects.")}


def test_bands(spark):
    assert [one(spark, bands.band("lcp", F.col("v").try_cast("double")), v=v) for v in ("2500", "2501", "4001", "x")] == ["good", "needs_improvement", "poor", "unmeasured"]
    assert one(spark, bands.cls(F.col("v")), v="0.1abc") is None
    assert [one(spark, bands.crawl_coverage(F.col("c").try_cast("boolean"), F.col("p").try_cast("boolean")), c=c, p=p) for c, p in (("false", "true"), ("false", "x"), ("true", "x"), ("x", "false"))] == ["page_limit", "stopped_early", "whole_crawl", "not_recorded"]
    assert [one(spark, bands.differs(F.lit(True), F.col("a"), F.col("b")), a=a, b=b) for a, b in ((5, 10_000), (4, 10_000), (1, 0))] == [True, False, False]


def test_plain_addresses_are_not_taken_apart(monkeypatch):
    """What ``resolver`` reads by itself is what taking the address apart gives, and plain addresses aren't taken apart."""
    bases = ["https://a.example/", "https://a.example", "http://a.example/b/c", "https://a.example/b/", "https://a.example:8443/b", "https://A.example/B?c", "https://a.example/b/../c", "https://a.example/b//c", "ftp://a/b", "http://[x/y", ""]
    steps = ["a", "/a", "/a/", "/a/b.c", "a/b", "a.", "%7e", "~x+y-z_", "/..", "..", "./a", "/.a", "//b.example/c", "/a//b", "", "/", "?q", "#f", "/a?b=c&d#e", "/a#b?c", " /a ", "/a\t/b", "\\a", "a:b", "mailto:x", "é", "/é", "/a b", "/a;b", "a?[", "/%", "c:/d"]
    hosts = ["http://b.example", "https://b.example", "https://B.example", "https://b.example:443", "http://b.example:443", "https://u@b.example", "https://-b", "https://b..c.", "https:", "ftp://b", "https://", "https://[b", "https://b.example:99999"]
    raws = steps + [h + s for h in hosts for s in steps]
    for base in bases:
        one = urls.resolver(base)
        for raw in raws:
            assert one(raw) == urls.resolve(raw, base), (raw, base)

    def met(*_):
        raise AssertionError

    monkeypatch.setattr(urls, "resolve", met)
    urls._resolve_once.cache_clear()
    assert [urls.resolver("https://a.example/b/c")(x) for x in ("/o1", "d.png?w=1", "https://b.example")] == ["https://a.example/o1", "https://a.example/b/d.png", "https://b.example/"]


def test_markup_is_read_once(spark):
    """Every use of a value once worked it out again."""
    h = F.col("html")
    times = lambda c, part: spark.createDataFrame([("",)], "html string").select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count(part)
    assert times(html.description(h), "<meta") == 1
    assert times(html.plain_text(h), "&#x0*") == 2  # whether it is there, and what it is
    assert times(html.content(h, F.lit(True)), "<main") == 2


def test_entities_and_regions_stay_as_they_were(spark):
    rows = [("a \u0001 b",), ("&amp;lt; \u0001 &x; &#1;",), ("&#x41;&#66;&#xD800;&#31;&amp;&AMP;&#x110000; & &;",), ("",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "html string").select(html.visible_text(F.col("html")), html.plain_text(F.col("html"))).collect()]
    assert got == [("a & b", "a \u0001 b"), ("&lt; &", "&lt; \u0001 &x; &#1;"), ("&#x41; &#xd800; &&&#x110000; & &;", "AB&#xD800;&#31;&&&#x110000; & &;"), ("", None), (None, None)]
