import datetime as dt

import pytest
from crawls import BASE, crawl, found, page

EN_DE = {"en": "/en", "de": "/de"}
LONG = "d" * 64


def say(spark, rule, pages, **options):
    return found(crawl(spark, pages, **options), rule)


def test_missing_locale(spark):
    pages = [page("/en", hreflang=EN_DE), page("/de", hreflang=EN_DE)]
    (url, d), = say(spark, "missing_locale", pages, locales=["en", "de", "fr"])
    assert url == "/de" and d["missingLocale"] == "fr" and d["presentLocales"] == ["de", "en"] and d["groupKey"] == f"{BASE}/de"
    assert say(spark, "missing_locale", pages, locales=["en", "de"]) == []
    assert say(spark, "missing_locale", pages, locales=["fr"], complete=False) == []
    assert say(spark, "missing_locale", [page("/a"), page("/b")], locales=["fr"]) == []


def test_a_region_answers_its_language_but_not_the_reverse(spark):
    pages = [page("/a", hreflang={"en-gb": "/a", "de": "/b"}), page("/b", hreflang={"en-gb": "/a", "de": "/b"})]
    assert say(spark, "missing_locale", pages, locales=["en", "de"]) == []
    assert len(say(spark, "missing_locale", pages, locales=["en", "de-at"])) == 1


def test_failed_targets(spark):
    one = [page("/en", hreflang=EN_DE), page("/de", status=404)]
    (url, d), = say(spark, "hreflang_target_failed", one)
    assert (url, d["locale"], d["httpStatus"]) == ("/en", "de", 404)
    all3 = EN_DE | {"fr": "/fr"}
    several = [page("/en", hreflang=all3), page("/de", status=500, error=None), page("/fr", hreflang=all3)]
    (url, d), = say(spark, "variant_diverged", several)
    assert url is None and d["brokenUrl"] == f"{BASE}/de" and d["declaredBy"] == [f"{BASE}/en", f"{BASE}/fr"]
    assert say(spark, "hreflang_target_failed", several) == []  # the family speaks for it
    assert say(spark, "variant_diverged", one) == []


def test_unreached_targets_only_inside_the_scope(spark):
    pages = [page("/en", hreflang={"en": "/en", "de": "/de", "fr": "https://other.test/fr"})]
    (_, d), = say(spark, "hreflang_target_unreached", pages)
    assert d["target"] == f"{BASE}/de"
    assert say(spark, "hreflang_target_unreached", pages, exclude=["/de"]) == []
    assert say(spark, "hreflang_target_unreached", pages, complete=False) == []


def test_family_defects(spark):
    def defects(pages):
        rows = say(spark, "hreflang_family_inconsistent", pages)
        return [tuple(x[k] for k in ("url", "kind", "sibling")) for _, d in rows for x in d["defects"]]

    assert defects([page("/en", hreflang=EN_DE), page("/de", hreflang=EN_DE)]) == []
    assert defects([page("/en", hreflang=EN_DE), page("/de", hreflang={"de": "/de"})]) == [(f"{BASE}/de", "not_reciprocated", f"{BASE}/en")]
    full = EN_DE | {"fr": "/fr"}
    found_ = defects([page("/en", hreflang=full), page("/de", hreflang=EN_DE), page("/fr", hreflang={"en": "/en", "fr": "/fr"})])
    assert sorted(found_) == [(f"{BASE}/de", "incomplete", f"{BASE}/fr"), (f"{BASE}/fr", "incomplete", f"{BASE}/de")]
    assert (f"{BASE}/de", "no_self_reference", None) in defects([page("/en", hreflang=EN_DE), page("/de", hreflang={"en": "/en"})])
    # a language that is declared elsewhere is declared
    assert defects([page("/en", hreflang={"en": "/en", "de": "/de-a"}), page("/de-a", hreflang={"de": "/de-a", "en": "/en"}), page("/de-b", hreflang={"de": "/de-b", "en": "/en"})]) == []


def test_no_hreflang(spark):
    (url, d), = say(spark, "no_hreflang", [page("/de/blog"), page("/blog"), page("/zz/blog")])
    assert (url, d["impliedLocale"]) == ("/de/blog", "de")
    assert say(spark, "no_hreflang", [page("/de/blog", hreflang={"en": "/en"})]) == []


def test_content(spark):
    pair = [page("/en", hreflang=EN_DE, digest=LONG, length=300, isolated=True), page("/de", hreflang=EN_DE, digest=LONG, length=300, isolated=True)]
    (url, d), = say(spark, "content_untranslated", pair)
    assert url is None and d["kind"] == "identical_to_siblings" and d["locales"] == ["de", "en"]
    assert say(spark, "content_duplicated", pair) == []  # the same pages are named already
    (url, d), = say(spark, "content_untranslated", [page("/a", markers=["lorem_ipsum"])], complete=False)
    assert (url, d["kind"]) == ("/a", "placeholder_markers")
    (_, d), = say(spark, "content_duplicated", [page("/a", digest=LONG, isolated=True), page("/b", digest=LONG, isolated=True)])
    assert d["urls"] == [f"{BASE}/a", f"{BASE}/b"]
    assert say(spark, "content_duplicated", [page("/a", digest=LONG, isolated=True), page("/b", digest=LONG, isolated=True, canonicals=["/a"])]) == []
    assert say(spark, "content_duplicated", [page("/a", digest=LONG), page("/b", digest=LONG)]) == []
    (_, d), = say(spark, "content_structure_differs", [page("/en", hreflang=EN_DE, isolated=True, blocks=["form"]), page("/de", hreflang=EN_DE, isolated=True)])
    assert [x["block"] for x in d["differences"]] == ["form"]


def test_metadata(spark):
    assert [d["fields"] for _, d in say(spark, "metadata_missing", [page("/a", title=None, description=None), page("/b"), page("/c", title=None, html=False), page("/d", title=None, status=404)])] == [["title", "description"]]
    (_, d), = say(spark, "metadata_duplicated", [page("/en/a", title="T"), page("/en/b", title="T"), page("/de/a", title="T"), page("/x", title="T")])
    assert (d["language"], d["urls"]) == ("en", [f"{BASE}/en/a", f"{BASE}/en/b"])
    (_, d), = say(spark, "metadata_duplicated", [page("/a", title="T"), page("/b", title="T")])
    assert d["language"] is None


def test_canonicals(spark):
    assert say(spark, "canonical_missing", [page("/a"), page("/b")]) == []
    assert [u for u, _ in say(spark, "canonical_missing", [page("/a"), page("/b", canonicals=["/b"])])] == ["/a"]
    assert [d["kind"] for _, d in say(spark, "canonical_conflicting", [page("/a", canonicals=["/x", "/y"])])] == ["multiple"]
    chain = [page("/a", canonicals=["/b"]), page("/b", canonicals=["/c"]), page("/c", canonicals=["/c"])]
    assert [(u, d["targetCanonical"]) for u, d in say(spark, "canonical_conflicting", chain)] == [("/a", f"{BASE}/c")]
    assert [d["kind"] for _, d in say(spark, "canonical_target_broken", [page("/a", canonicals=["/gone"]), page("/gone", status=404)])] == ["failed"]
    assert [d["kind"] for _, d in say(spark, "canonical_target_broken", [page("/a", canonicals=["/never"])])] == ["unreached"]
    assert say(spark, "canonical_target_broken", [page("/a", canonicals=["https://other.test/x"])]) == []


def test_noindex_in_both_channels(spark):
    pages = [page("/m", robots=[(None, ["noindex"])]), page("/h", x_robots="googlebot: none, nofollow"), page("/ok", x_robots="noarchive"), page("/dead", status=404, x_robots="noindex")]
    rows = say(spark, "noindex_present", pages)
    assert [(u, d["channels"]) for u, d in rows] == [("/h", ["header"]), ("/m", ["markup"])]
    assert rows[0][1]["sources"] == [{"channel": "header", "crawler": "googlebot", "directive": "none"}]


def test_links(spark):
    pages = [page("/a", links=["/gone", "/flaky", "/a"]), page("/gone", status=404), page("/flaky", status=503)]
    (_, d), = say(spark, "link_broken", pages)
    assert (d["target"], d["linkedFrom"], d["confirmed"]) == (f"{BASE}/gone", [f"{BASE}/a"], False)
    both = say(spark, "link_broken", pages, reverified=[(f"{BASE}/flaky", 503, None, True)])
    assert sorted(d["confirmed"] for _, d in both) == [False, True]
    # what an alternate or a canonical already reports isn't reported again
    assert say(spark, "link_broken", [page("/a", links=["/gone"], canonicals=["/gone"]), page("/gone", status=404)]) == []
    out = "https://other.test/x"
    rows = [(out, 404, None, False), ("https://other.test/y", 403, None, False)]
    pages = [page("/a", links=[out, "https://other.test/y"])]
    assert len(say(spark, "link_external_broken", pages, external=rows, external_complete=True)) == 1
    assert say(spark, "link_external_broken", pages, external=rows) == []


def test_redirects(spark):
    two = [("/s", 301, "/m"), ("/m", 301, "/e")]
    (_, d), = say(spark, "redirect_chain", [page("/e", chain=two), page("/a", links=["/s"])])
    assert (d["kind"], d["from"], d["to"], d["linkedFrom"]) == ("chain", f"{BASE}/s", f"{BASE}/e", [f"{BASE}/a"])
    assert say(spark, "redirect_chain", [page("/e", chain=two[1:])]) == []
    assert say(spark, "redirect_chain", [page("/e", chain=[("/e", 301, "/e/"), ("/e/", 301, "/f")])]) == []
    (_, d), = say(spark, "redirect_chain", [page("/one", status=None, error="Redirect loop.", chain=[("/one", 301, "/two"), ("/two", 301, "/one")])])
    assert (d["kind"], d["to"]) == ("loop", None)


@pytest.mark.parametrize("valid_to, error, kind", [("2025-12-01", None, "expired"), ("2026-01-20", None, "expiring_soon"), ("2027-01-01", "ERR_TLS_CERT_ALTNAME_INVALID", "hostname_mismatch"), ("2027-01-01", "DEPTH_ZERO", "untrusted_chain"), ("2027-01-01", None, None)])
def test_certificates(spark, valid_to, error, kind):
    rows = say(spark, "certificate_problem", [page("/")], certificates=[(BASE, "CA", "shop", None, dt.datetime.fromisoformat(valid_to), error)])
    assert [d["kind"] for _, d in rows] == ([kind] if kind else [])


def test_security_headers(spark):
    good = {"strict-transport-security": "max-age=63072000"}
    (_, d), = say(spark, "security_header_contradiction", [page("/", headers=good), page("/b", headers=good), page("/legacy")])
    assert (d["kind"], d["affectedUrls"], d["pagesPublishing"]) == ("inconsistent", [f"{BASE}/legacy"], 2)
    assert say(spark, "security_header_contradiction", [page("/", headers=good), page("/legacy")], complete=False) == []
    assert [d["kind"] for _, d in say(spark, "security_header_contradiction", [page("/", headers={"x-content-type-options": "sniff"})])] == ["malformed"]
    assert say(spark, "security_header_contradiction", [page("/"), page("/b")]) == []


def entry(path):
    return (BASE + path, BASE + path)


def test_sitemap(spark):
    pages = [page("/", links=["/a"]), page("/a"), page("/gone", status=404), page("/no", robots=[(None, ["noindex"])])]
    (_, d), = say(spark, "sitemap_url_failed", pages, sitemap=[entry("/gone"), entry("/a")])
    assert [e["normalised"] for e in d["entries"]] == [f"{BASE}/gone"]
    (_, d), = say(spark, "page_missing_from_sitemap", pages, sitemap=[entry("/")], complete=False)
    assert d["urls"] == [f"{BASE}/a"]
    assert say(spark, "page_missing_from_sitemap", pages) == []
    site = [page("/", links=["/blog"]), page("/blog")]
    (_, d), = say(spark, "page_orphaned", site, entry=BASE + "/", sitemap=[entry("/"), entry("/blog"), entry("/blog/x"), ("https://other.test/y", "https://other.test/y")])
    assert d["urls"] == [f"{BASE}/blog/x"]
    assert say(spark, "page_orphaned", site, entry=BASE + "/", narrowed=True, sitemap=[entry("/blog/x")]) == []
    assert say(spark, "page_orphaned", site, entry=BASE + "/", sitemap=[entry("/blog/x")], aliases=[(f"{BASE}/blog/x", f"{BASE}/blog", [])]) == []


def test_robots(spark):
    rules = [(1, ["*"], 0, "disallow", "/a", "Disallow: /a", 2, True), (2, ["googlebot"], 0, "disallow", "/private", "Disallow: /private", 4, True), (2, ["googlebot"], 1, "allow", "/private/open", "Allow: /private/open", 5, True)]
    (_, d), = say(spark, "robots_blocks_indexable", [page("/")], robots=rules, sitemap=[entry("/a"), entry("/private/x"), entry("/private/open/y")])
    assert (d["rule"], d["userAgentGroup"], d["urls"]) == ("/private", "googlebot", [f"{BASE}/private/x"])


def test_images_console_and_pictures(spark):
    imgs = (3, 2, 1, ("/i/a.png", "/i/b.png"), ("/i/a.png",), ("/i/a.png", "/i/b.png", "/i/c.webp"))
    assert [(d["count"], d["of"], d["listed"]) for _, d in say(spark, "image_missing_dimensions", [page("/", images=imgs), page("/n", images=None), page("/x", status=404, images=imgs)])] == [(2, 3, 2)]
    assert [d["count"] for _, d in say(spark, "image_legacy_format", [page("/", images=imgs)])] == [1]
    weights = [(f"{BASE}/i/a.png", 1_400_000), (f"{BASE}/i/b.png", 8_000), (f"{BASE}/i/c.webp", None)]
    assert [d["images"] for _, d in say(spark, "image_oversized", [page("/", images=imgs)], image_weights=weights)] == [[{"url": f"{BASE}/i/a.png", "bytes": 1_400_000}]]
    assert say(spark, "image_oversized", [page("/", images=imgs)], image_weights=weights, weights_complete=False) == []
    seen = [(f"{BASE}/", 1, 2, "0.1", 2, 1, ["boom"], None), (f"{BASE}/t", 1, 2, "0.1", 0, 5, [], None)]
    assert [u for u, _ in say(spark, "console_error", [page("/")], observations=seen)] == ["/"]
    pictures = [(f"{BASE}/a", True, None, 500, 1_000_000, [], False, 0), (f"{BASE}/b", True, None, 499, 1_000_000, [], False, 9), (f"{BASE}/c", False, "missing", None, None, [], False, 0)]
    assert [u for u, _ in say(spark, "visual_changed", [page("/")], visual=pictures)] == ["/a"]


def test_a_sound_site_has_no_findings_and_detection_repeats_itself(spark):
    from lingoscope.plans.rules import detect

    alternates = {"en": "/en", "de": "/de"}
    sound = crawl(spark, [page("/en", hreflang=alternates, links=["/de"]), page("/de", hreflang=alternates, links=["/en"])], locales=["en", "de"])
    assert detect(sound).count() == 0
    bad = crawl(spark, [page("/a", title=None, links=["/gone"]), page("/gone", status=404), page("/b", title="T", description="x"), page("/c", title="T")])
    first, second = (detect(bad, ["metadata_missing", "metadata_duplicated", "link_broken"]).collect() for _ in range(2))
    assert first == second and [r["ord"] for r in first] == [1, 2, 3]
