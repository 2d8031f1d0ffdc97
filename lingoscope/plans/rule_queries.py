"""Every rule over one made-up shop, whose pages are worked out from the rows of ``part``.

A part is a page; four neighbouring ones are a family in four languages.  What a
page says and lacks follows from its number, so a query's SQL can state directly
what a rule must find.  The scalar facts (``FACTS``) are the input and are shared
with the SQL as plain arithmetic; lists and maps are put together on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoscope import schema as S
from lingoscope.operators.storage import present, spread, stored
from lingoscope.plans import findings, reports, rules, runs, variants
from lingoscope.plans.catalogue import joined, query, table
from lingoscope.sources import pages as fetched
from lingoscope.sources import robots, sitemap

SHOP = "https://shop.example"
ROBOTS_TXT = "# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: Googlebot\nUser-agent: news\nDisallow: /de/p1 # some\nAllow: /de/p11\nDisallow: /fr/*9$\nDisallow: /en/p?x\nDisallow:\nSitemap: https://shop.example/sitemap.xml\n"

_PATH = "'/' || CASE {m} WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END || '/p' || CAST({f} AS VARCHAR(20))"


def _url(p: str) -> str:
    return f"('{SHOP}' || " + _PATH.format(m=f"(({p}) % 4)", f=f"(CAST(floor(({p}) / 4) AS BIGINT))") + ")"


#: name -> expression over p, in SQL that both engines read.
FACTS = {
    "f": "CAST(floor(p / 4) AS BIGINT)",
    "m": "CAST(p % 4 AS INT)",
    "url": _url("p"),
    "status": "CASE WHEN p % 53 = 7 THEN NULL WHEN p % 11 = 3 THEN 404 WHEN p % 29 = 5 THEN 500 ELSE 200 END",
    "err": "CASE WHEN p % 53 = 7 THEN 'timeout' END",
    "is_html": "p % 43 <> 0",
    "loc": "CASE p % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END",
    "own_tag": "CASE WHEN p % 12 = 0 THEN 'en-gb' ELSE CASE p % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END END",
    "declares": "CASE WHEN p % 7 = 2 OR floor(p / 4) % 10 = 9 THEN 'none' WHEN p % 13 = 4 THEN 'self' ELSE 'all' END",
    "title": "CASE WHEN p % 19 <> 1 THEN 'Title ' || CAST(p % 400 AS VARCHAR(20)) END",
    "description": "CASE WHEN p % 23 <> 2 THEN 'About ' || CAST(p AS VARCHAR(20)) END",
    "isolated": "p % 10 <> 7",
    "digest": "CASE WHEN p % 6 = 0 THEN NULL WHEN floor(p / 4) % 5 = 0 THEN 'family ' || CAST(CAST(floor(p / 4) AS BIGINT) AS VARCHAR(20)) ELSE 'text ' || CAST(p % 300 AS VARCHAR(20)) END",
    "marked": "p % 47 = 9",
    "form": "p % 21 = 0",
    "table_": "floor(p / 4) % 2 = 0",
    "media": "p % 33 = 0",
    "canonical": f"CASE WHEN p % 3 = 1 THEN {_url('p')} WHEN p % 3 = 2 THEN {_url('p - p % 4 + (p + 1) % 4')} END",
    "second": "CASE WHEN p % 31 = 3 THEN 'https://shop.example/x' END",
    "meta_robots": "CASE WHEN p % 37 = 4 THEN 'robots' WHEN p % 59 = 5 THEN 'googlebot' END",
    "x_robots": "CASE WHEN p % 41 = 6 THEN 'noindex' WHEN p % 61 = 7 THEN 'googlebot: nofollow, NoIndex' WHEN p % 67 = 8 THEN 'noarchive' END",
    "sniff": "CASE WHEN p % 73 = 9 THEN 'sniff' ELSE 'nosniff' END",
    "hsts": "CASE WHEN p % 2 = 0 THEN 'max-age=60' END",
    "again_status": "CASE WHEN p % 29 = 5 AND p % 4 = 0 THEN 500 WHEN p % 29 = 5 AND p % 4 = 1 THEN 200 END",
    "again_err": "CASE WHEN p % 53 = 7 AND p % 2 = 0 THEN 'timeout' END",
    "seen_again": "(p % 29 = 5 AND p % 4 < 2) OR (p % 53 = 7 AND p % 2 = 0)",
    "confirmed": "(p % 29 = 5 AND p % 4 = 0) OR (p % 53 = 7 AND p % 2 = 0)",
    "link_next": _url("p + 1"),
    "link_half": _url("floor(p / 2) + 1"),
    "link_deep": f"CASE WHEN p % 4 = 0 THEN {_url('floor(p / 2) + 1')} || '/x' END",
    "link_out": "'https://out.example/e' || CAST(p % 97 AS VARCHAR(20))",
    "link_old": "CASE WHEN p % 25 = 9 THEN 'https://shop.example/old/' || CAST(p - 1 AS VARCHAR(20)) END",
    "route": "CASE p % 25 WHEN 8 THEN 'chain' WHEN 9 THEN 'loop' WHEN 10 THEN 'slash' END",
    "undimensioned": "CAST(CASE WHEN p % 12 = 1 THEN 2 ELSE 0 END AS INT)",
    "legacy": "CAST(CASE WHEN p % 14 = 1 THEN 1 ELSE 0 END AS INT)",
    "image": "'https://shop.example/img/' || CAST(p % 30 AS VARCHAR(20)) || '.jpg'",
}
_SPARK = {name: sql.replace("AS VARCHAR(20)", "AS STRING") for name, sql in FACTS.items()}

#: What holds at the end: a second look replaces the first.
PG = (
    "pg AS (SELECT *, status_ AS http, err_ AS error, err_ IS NOT NULL OR status_ IS NULL OR status_ >= 400 AS failed, NOT (err_ IS NOT NULL OR status_ IS NULL OR status_ >= 400) AND is_html AS page FROM "
    "(SELECT *, CASE WHEN seen_again THEN again_status ELSE status END AS status_, CASE WHEN seen_again THEN again_err ELSE err END AS err_ FROM "
    "(SELECT p_partkey AS p, " + ", ".join(f"{sql} AS {name}" for name, sql in ((n, s.replace("p_partkey", "p")) for n, s in FACTS.items())) + " FROM (SELECT p_partkey, p_partkey AS p FROM part))))"
)
#: Every declared alternate: (p, url, locale, target).
DECL = (
    f"decl AS (SELECT p, url, CASE WHEN j = m THEN own_tag ELSE CASE j WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END END AS locale, {_url('4 * f + j')} AS target "
    "FROM pg, (VALUES (0), (1), (2), (3)) t(j) WHERE declares = 'all' OR (declares = 'self' AND j = m) "
    "UNION ALL SELECT p, url, 'it', 'https://shop.example/it/p' || f FROM pg WHERE declares <> 'none' AND p % 17 = 6 "
    "UNION ALL SELECT p, url, 'pt', 'https://elsewhere.example/pt/p' || f FROM pg WHERE declares <> 'none' AND p % 19 = 8 "
    f"UNION ALL SELECT p, url, 'x-default', {_url('4 * f')} FROM pg WHERE declares <> 'none' AND p % 5 = 0)"
)
TAGGED = "tagged AS (SELECT * FROM decl WHERE locale <> 'x-default' AND url <> target)"
#: Families by following declarations to recorded pages, in either direction.
FAM = (
    "edge AS (SELECT decl.url AS u, target AS v FROM decl JOIN pg t ON t.url = target), "
    "reach(u, v) AS (SELECT url, url FROM pg UNION SELECT reach.u, e.v FROM reach JOIN (SELECT u, v FROM edge UNION SELECT v, u FROM edge) e ON reach.v = e.u), "
    "fam AS (SELECT pg.*, g.group_key, coalesce(own.locale, given.locale, loc) AS locale FROM pg JOIN (SELECT u, min(v) AS group_key FROM reach GROUP BY u) g ON g.u = pg.url "
    "LEFT JOIN (SELECT url, min(locale) AS locale FROM decl WHERE url = target AND locale <> 'x-default' GROUP BY url) own ON own.url = pg.url "
    "LEFT JOIN (SELECT target, min_by(locale, (url, locale)) AS locale FROM tagged GROUP BY target) given ON given.target = pg.url), "
    "member AS (SELECT * FROM fam WHERE group_key IN (SELECT group_key FROM fam GROUP BY group_key HAVING count(*) >= 2))"
)
DIVERGED = (
    "diverged AS (SELECT b.group_key, b.url AS target, b.locale, b.http, b.error, d.declarers, h.healthy FROM member b "
    "JOIN (SELECT target, list_sort(list(DISTINCT url)) AS declarers FROM tagged GROUP BY target HAVING count(DISTINCT url) >= 2) d ON d.target = b.url "
    "JOIN (SELECT group_key, list_sort(list(DISTINCT url)) AS healthy FROM member WHERE NOT failed GROUP BY group_key) h ON h.group_key = b.group_key WHERE b.failed)"
)
FAILED_TARGET = "failed_target AS (SELECT t.url, t.locale, t.target, q.http, q.error FROM tagged t JOIN pg q ON q.url = t.target AND q.failed WHERE t.target NOT IN (SELECT target FROM diverged))"
OWN = "own AS (SELECT url, locale, target FROM decl WHERE locale <> 'x-default')"
DEFECTS = (
    "healthy AS (SELECT * FROM member WHERE NOT failed), pair AS (SELECT a.group_key, a.url, b.url AS sibling, b.locale AS sibling_locale FROM healthy a JOIN healthy b ON a.group_key = b.group_key AND a.url <> b.url "
    "WHERE left(a.locale, 2) <> left(b.locale, 2) AND NOT EXISTS (SELECT 1 FROM own WHERE own.url = a.url AND left(own.locale, 2) = left(b.locale, 2))), "
    "kinds AS (SELECT group_key, url, CASE WHEN EXISTS (SELECT 1 FROM own WHERE own.url = pair.sibling AND own.target = pair.url) THEN 'not_reciprocated' WHEN EXISTS (SELECT 1 FROM own WHERE own.url = pair.url) THEN 'incomplete' END AS kind, "
    "sibling, sibling_locale AS \"siblingLocale\", CAST(NULL AS VARCHAR) AS locale FROM pair UNION ALL "
    "SELECT group_key, url, 'no_self_reference', NULL, NULL, locale FROM healthy WHERE EXISTS (SELECT 1 FROM own WHERE own.url = healthy.url) AND NOT EXISTS (SELECT 1 FROM own WHERE own.url = healthy.url AND left(own.locale, 2) = left(healthy.locale, 2))), "
    "inconsistent AS (SELECT group_key, list_sort(list({'url': url, 'kind': kind, 'sibling': sibling, 'siblingLocale': \"siblingLocale\", 'locale': locale})) AS defects FROM kinds WHERE kind IS NOT NULL GROUP BY group_key)"
)
IDENTICAL = (
    "identical AS (SELECT group_key, digest, list_sort(list(DISTINCT url)) AS urls, list_sort(list(DISTINCT locale)) AS locales FROM member WHERE page AND digest IS NOT NULL "
    "GROUP BY group_key, digest HAVING count(DISTINCT left(locale, 2)) >= 2)"
)
SINGLE = "single AS (SELECT p, url, coalesce(canonical, second) AS canonical FROM pg WHERE page AND (canonical IS NULL) <> (second IS NULL) AND coalesce(canonical, second) <> url)"
BROKEN_CANONICAL = "broken_canonical AS (SELECT s.url, s.canonical, CASE WHEN q.url IS NULL THEN 'unreached' ELSE 'failed' END AS kind, q.http, q.error FROM single s LEFT JOIN pg q ON q.url = s.canonical WHERE q.url IS NULL OR q.failed)"
NOINDEX = (
    "noindex AS (SELECT url, 'markup' AS channel, CASE meta_robots WHEN 'googlebot' THEN 'googlebot' END AS crawler, CASE meta_robots WHEN 'googlebot' THEN 'none' ELSE 'noindex' END AS directive FROM pg WHERE NOT failed AND meta_robots IS NOT NULL "
    "UNION ALL SELECT url, 'header', CASE WHEN x_robots LIKE 'googlebot%' THEN 'googlebot' END, 'noindex' FROM pg WHERE NOT failed AND lower(x_robots) LIKE '%noindex%')"
)
LINK = "link AS (SELECT DISTINCT url AS src, dst FROM (SELECT url, unnest([link_next, link_half, link_deep, link_out, link_old]) AS dst FROM pg) WHERE dst IS NOT NULL AND dst <> url)"
ENTRY = (
    "entry AS (SELECT url AS raw, url FROM pg WHERE p % 3 <> 2 AND p % 45 <> 1 UNION ALL SELECT url || '/x?from=map', url || '/x' FROM pg WHERE p % 3 = 1 "
    "UNION ALL SELECT 'https://cdn.example/' || p, 'https://cdn.example/' || p FROM pg WHERE p % 40 = 0 UNION ALL SELECT 'ftp://bad/' || p, NULL FROM pg WHERE p % 90 = 0), "
    "comparable AS (SELECT url, min(raw) AS raw FROM entry WHERE url LIKE 'https://shop.example/%' GROUP BY url)"
)
_BASE = (PG, DECL, TAGGED, FAM)
_MAP = "'sitemapSource': 'sitemap.xml', 'discovery': 'robots'"


def _sql(*parts: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def _say(url: str, detail: str, source: str) -> str:
    return f"SELECT {url} AS url, CAST(to_json({{{detail}}}) AS VARCHAR) AS detail FROM {source}"


_LINKED = "list_sort(list(DISTINCT src)) AS linked"

#: What each rule must say, as SQL.
EXPECTED = {
    "missing_locale": _sql(*_BASE, select=_say("urls[1]", "'groupKey': group_key, 'missingLocale': e, 'presentLocales': present, 'memberUrls': urls",
        "(SELECT group_key, list_sort(list(DISTINCT locale)) AS present, list_sort(list(DISTINCT url)) AS urls FROM member GROUP BY group_key HAVING NOT bool_and(failed)), (VALUES ('en'), ('de'), ('fr'), ('it')) x(e) "
        "WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(present) AS l) WHERE l = e OR l LIKE e || '-%')")),
    "hreflang_target_failed": _sql(*_BASE, DIVERGED, FAILED_TARGET, select=_say("url", "'declaredBy': url, 'locale': locale, 'target': target, 'httpStatus': http, 'fetchError': error", "failed_target")),
    "hreflang_target_unreached": _sql(PG, DECL, TAGGED, select=_say("url", "'declaredBy': url, 'locale': locale, 'target': target", "tagged WHERE target LIKE 'https://shop.example/%' AND target NOT IN (SELECT url FROM pg)")),
    "no_hreflang": _sql(*_BASE, OWN, DEFECTS, select=_say("url", "'url': url, 'impliedLocale': loc",
        "pg WHERE page AND NOT EXISTS (SELECT 1 FROM decl WHERE decl.url = pg.url AND target <> decl.url) AND url NOT IN (SELECT url FROM member WHERE group_key IN (SELECT group_key FROM inconsistent))")),
    "hreflang_family_inconsistent": _sql(*_BASE, OWN, DEFECTS, select=_say("NULL::VARCHAR", "'groupKey': group_key, 'memberUrls': urls, 'defects': defects",
        "inconsistent JOIN (SELECT group_key, list_sort(list(DISTINCT url)) AS urls FROM member GROUP BY group_key) USING (group_key)")),
    "variant_diverged": _sql(*_BASE, DIVERGED, select=_say("NULL::VARCHAR", "'groupKey': group_key, 'brokenUrl': target, 'locale': locale, 'httpStatus': http, 'fetchError': error, 'declaredBy': declarers, 'healthyUrls': healthy", "diverged")),
    "content_untranslated": _sql(*_BASE, IDENTICAL, select=_say("url", "'kind': 'placeholder_markers', 'url': url, 'locale': locale, 'markers': ['lorem_ipsum']", "fam WHERE page AND marked") + " UNION ALL "
        + _say("NULL", "'kind': 'identical_to_siblings', 'groupKey': group_key, 'urls': urls, 'locales': locales", "identical")),
    "content_structure_differs": _sql(*_BASE, "iso AS (SELECT * FROM member WHERE page AND isolated)",
        "has AS (SELECT group_key, url, 1 AS nth, 'form' AS block, form AS h FROM iso UNION ALL SELECT group_key, url, 2, 'table', table_ FROM iso UNION ALL SELECT group_key, url, 3, 'media', media FROM iso)",
        "differ AS (SELECT group_key, nth, block, list_sort(list(url) FILTER (h)) AS present, list_sort(list(url) FILTER (NOT h)) AS absent FROM has GROUP BY ALL HAVING bool_or(h) AND NOT bool_and(h))",
        select=_say("NULL::VARCHAR", "'groupKey': group_key, 'memberUrls': urls, 'differences': d",
        "(SELECT group_key, list({'block': block, 'present': present, 'absent': absent} ORDER BY nth) AS d FROM differ GROUP BY group_key) JOIN (SELECT group_key, list_sort(list(DISTINCT url)) AS urls FROM iso GROUP BY group_key) USING (group_key)")),
    "metadata_missing": _sql(PG, select=_say("url", "'url': url, 'fields': list_filter([CASE WHEN title IS NULL THEN 'title' END, CASE WHEN description IS NULL THEN 'description' END], lambda x: x IS NOT NULL)", "pg WHERE page AND (title IS NULL OR description IS NULL)")),
    "metadata_duplicated": _sql(*_BASE, select=_say("NULL::VARCHAR", "'field': field, 'language': language, 'value': value, 'urls': urls",
        "(SELECT field, language, value, list_sort(list(DISTINCT url)) AS urls FROM (SELECT 'title' AS field, left(locale, 2) AS language, title AS value, url FROM fam WHERE page UNION ALL SELECT 'description', left(locale, 2), description, url FROM fam WHERE page) "
        "WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT url) >= 2)")),
    "canonical_missing": _sql(PG, select=_say("url", "'url': url, 'pagesDeclaringCanonical': (SELECT count(*) FROM pg WHERE page AND (canonical IS NOT NULL OR second IS NOT NULL))", "pg WHERE page AND canonical IS NULL AND second IS NULL")),
    "canonical_conflicting": _sql(PG, SINGLE, select=_say("url", "'kind': 'multiple', 'url': url, 'canonicals': list_sort([canonical, second])", "pg WHERE page AND canonical IS NOT NULL AND second IS NOT NULL") + " UNION ALL "
        + _say("s.url", "'kind': 'chain', 'url': s.url, 'canonical': s.canonical, 'targetCanonical': t.canonical", "single s JOIN single t ON t.url = s.canonical")),
    "canonical_target_broken": _sql(PG, SINGLE, BROKEN_CANONICAL,
        select=_say("url", "'kind': kind, 'url': url, 'canonical': canonical, 'httpStatus': http, 'fetchError': error", "broken_canonical")),
    "noindex_present": _sql(PG, NOINDEX, select=_say("url", "'url': url, 'sources': sources, 'channels': channels, 'indexingChannels': indexing",
        "(SELECT url, list({'channel': channel, 'crawler': crawler, 'directive': directive} ORDER BY channel) AS sources, list_sort(list(DISTINCT channel)) AS channels, "
        "list_filter([CASE WHEN any_value(x_robots) IS NOT NULL AND NOT bool_or(channel = 'header') THEN 'header' END, CASE WHEN any_value(meta_robots) IS NOT NULL AND NOT bool_or(channel = 'markup') THEN 'markup' END], lambda x: x IS NOT NULL) AS indexing "
        "FROM noindex JOIN pg USING (url) GROUP BY url)")),
    "content_duplicated": _sql(*_BASE, IDENTICAL, select=_say("NULL::VARCHAR", "'digest': digest, 'textLength': 300, 'urls': urls",
        "(SELECT digest, list_sort(list(DISTINCT url)) AS urls FROM pg WHERE page AND isolated AND digest IS NOT NULL GROUP BY digest HAVING count(*) >= 2 "
        "AND count(DISTINCT CASE WHEN (canonical IS NULL) = (second IS NULL) THEN url ELSE coalesce(canonical, second) END) >= 2) WHERE urls NOT IN (SELECT urls FROM identical)")),
    "link_broken": _sql(*_BASE, DIVERGED, FAILED_TARGET, SINGLE, BROKEN_CANONICAL, LINK,
        select=_say("NULL::VARCHAR", "'target': url, 'httpStatus': http, 'fetchError': error, 'confirmed': sure, 'linkedFrom': linked",
        f"(SELECT pg.url, http, error, NOT (error IS NULL AND coalesce(http BETWEEN 400 AND 499, false)) AS sure, {_LINKED} FROM pg JOIN link ON dst = pg.url WHERE failed AND ((error IS NULL AND http BETWEEN 400 AND 499) OR (seen_again AND confirmed)) "
        "AND pg.url NOT IN (SELECT target FROM failed_target) AND pg.url NOT IN (SELECT canonical FROM broken_canonical) GROUP BY ALL)")),
    "certificate_problem": "SELECT NULL::VARCHAR AS url, CAST(to_json({'kind': kind, 'origin': 'https://c' || s || '.example', 'validTo': strftime(TIMESTAMP '2026-01-01' + to_days(CAST(s % 80 - 20 AS INT)), '%Y-%m-%dT%H:%M:%S.000Z'), "
        "'daysRemaining': CAST(s % 80 - 20 AS INT), 'issuer': 'Authority', 'subject': 'c' || s, 'authorizationError': e}) AS VARCHAR) AS detail FROM (SELECT *, CASE WHEN s % 80 - 20 <= 0 THEN 'expired' WHEN e LIKE '%ALTNAME%' THEN 'hostname_mismatch' "
        "WHEN e IS NOT NULL THEN 'untrusted_chain' WHEN s % 80 - 20 <= 30 THEN 'expiring_soon' END AS kind FROM (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 7 = 0 THEN 'ERR_TLS_CERT_ALTNAME_INVALID' WHEN s_suppkey % 11 = 0 THEN 'SELF_SIGNED' END AS e FROM supplier)) WHERE kind IS NOT NULL",
    "security_header_contradiction": _sql(PG, "ok AS (SELECT * FROM pg WHERE NOT failed)", select=_say("NULL::VARCHAR", "'kind': 'malformed', 'header': 'x-content-type-options', 'value': 'sniff', 'affectedUrls': urls, 'pagesPublishing': (SELECT count(*) FROM ok)",
        "(SELECT list_sort(list(url)) AS urls FROM ok WHERE sniff = 'sniff' HAVING count(*) > 0)") + " UNION ALL "
        + _say("NULL", "'kind': 'inconsistent', 'header': 'strict-transport-security', 'value': NULL, 'affectedUrls': urls, 'pagesPublishing': (SELECT count(*) FROM ok WHERE hsts IS NOT NULL)",
        "(SELECT list_sort(list(url)) AS urls FROM ok WHERE hsts IS NULL HAVING count(*) > 0 AND EXISTS (SELECT 1 FROM ok WHERE hsts IS NOT NULL))")),
    "sitemap_url_failed": _sql(PG, ENTRY, select=_say("NULL::VARCHAR", f"{_MAP}, 'entries': e",
        "(SELECT list({'raw': raw, 'normalised': url, 'httpStatus': http, 'fetchError': error} ORDER BY url) AS e FROM comparable JOIN pg USING (url) WHERE failed HAVING count(*) > 0)")),
    "page_missing_from_sitemap": _sql(PG, ENTRY, NOINDEX, select=_say("NULL::VARCHAR", f"{_MAP}, 'sitemapEntryCount': (SELECT count(*) FROM entry), 'urls': urls",
        "(SELECT list_sort(list(url)) AS urls FROM pg WHERE page AND coalesce(canonical, url) = url AND second IS NULL AND url NOT IN (SELECT url FROM entry WHERE url IS NOT NULL) AND url NOT IN (SELECT url FROM noindex) HAVING count(*) > 0)")),
    "robots_blocks_indexable": _sql(PG, ENTRY, "judged AS (SELECT DISTINCT url, substr(url, 21) AS path FROM entry WHERE url LIKE 'https://shop.example/%')",
        "verdict AS (SELECT url, CASE WHEN path LIKE '/de/p11%' THEN NULL WHEN path LIKE '/de/p1%' THEN '/de/p1' WHEN path LIKE '/fr/%9' THEN '/fr/*9$' END AS rule FROM judged)",
        select=_say("NULL::VARCHAR", f"'rule': rule, 'ruleLine': CASE rule WHEN '/de/p1' THEN 'Disallow: /de/p1 # some' ELSE 'Disallow: /fr/*9$' END, 'ruleLineNumber': CASE rule WHEN '/de/p1' THEN 7 ELSE 9 END, 'userAgentGroup': 'googlebot', {_MAP}, 'urls': urls",
        "(SELECT rule, list_sort(list(url)) AS urls FROM verdict WHERE rule IS NOT NULL GROUP BY rule)")),
    "page_orphaned": _sql(PG, ENTRY, LINK, select=_say("NULL::VARCHAR", f"{_MAP}, 'urls': urls",
        "(SELECT list_sort(list(DISTINCT c.url)) AS urls FROM comparable c JOIN pg above ON above.url || '/x' = c.url WHERE c.url NOT IN (SELECT dst FROM link) HAVING count(*) > 0)")),
    "link_external_broken": _sql(PG, LINK, "gone AS (SELECT 'https://out.example/e' || k AS url, CASE k % 10 WHEN 3 THEN 404 WHEN 4 THEN 410 END AS http, CASE k % 10 WHEN 6 THEN 'dns' END AS error, CASE WHEN k % 10 = 6 THEN true ELSE false END AS sure FROM range(97) r(k) WHERE k % 10 IN (3, 4, 6))",
        select=_say("NULL::VARCHAR", "'target': url, 'httpStatus': http, 'fetchError': error, 'confirmed': sure, 'linkedFrom': linked", f"(SELECT gone.url, http, error, sure, {_LINKED} FROM gone JOIN link ON dst = gone.url GROUP BY ALL)")),
    "redirect_chain": _sql(PG, LINK, "start AS (SELECT p, route, url, 'https://shop.example/old/' || p AS a, 'https://shop.example/older/' || p AS b FROM pg WHERE route IN ('chain', 'loop'))",
        select=_say("NULL::VARCHAR", "'kind': route, 'from': a, 'to': CASE WHEN route = 'chain' THEN url END, 'hops': [{'url': a, 'status': 301, 'location': b}, {'url': b, 'status': 302, 'location': CASE WHEN route = 'chain' THEN url ELSE a END}], 'linkedFrom': coalesce(linked, [])",
        f"start LEFT JOIN (SELECT dst, {_LINKED} FROM link GROUP BY dst) ON dst = a")),
    "image_missing_dimensions": _sql(PG, select=_say("url", "'url': url, 'count': 2, 'of': 3, 'images': ['https://shop.example/a.png', 'https://shop.example/b.png'], 'listed': 2", "pg WHERE page AND undimensioned > 0")),
    "image_legacy_format": _sql(PG, select=_say("url", "'url': url, 'count': 1, 'of': 3, 'images': ['https://shop.example/a.png'], 'listed': 1", "pg WHERE page AND legacy > 0")),
    "image_oversized": _sql(PG, select=_say("url", "'url': url, 'count': 1, 'thresholdBytes': 500000, 'images': [{'url': image, 'bytes': p % 30 * 30000}], 'listed': 1", "pg WHERE page AND p % 30 * 30000 > 500000")),
    "console_error": _sql(PG, select=_say("url", "'url': url, 'count': CAST(p % 6 AS INT), 'thirdPartyCount': CAST(p % 4 AS INT), 'messages': ['failed ' || p]", "pg WHERE p % 9 = 2 AND p % 6 > 0")),
    "visual_changed": _sql(PG, select="SELECT url, '{\"url\":\"' || url || '\",\"changedPixels\":' || (p % 1000) || ',\"comparedPixels\":1000000,\"regions\":[{\"x\":1,\"y\":2,\"width\":3,\"height\":4}],\"regionsCapped\":false,\"heightDelta\":0,\"thresholdShare\":5.0E-4}' AS detail FROM "
        "pg WHERE p % 8 = 3 AND p % 16 <> 3 AND p % 1000 >= 500"),
}


def _arr(*items, kind="string") -> Column:
    return F.array_compact(F.array(*items)).cast(f"array<{kind}>")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p): the numbers of all parts, a few to each task, as a page is made of each."""
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")), "p")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p", *(F.expr(sql).alias(name) for name, sql in _SPARK.items()))


def _pages(facts: DataFrame) -> DataFrame:
    some = F.col("declares") != "none"
    sibling = lambda j: F.expr(_url(f"4 * f + {j}").replace("AS VARCHAR(20)", "AS STRING"))
    entry = lambda test, locale, target: F.when(test, F.struct(locale.alias("key"), target.alias("value")))
    declared = [entry((F.col("declares") == "all") | ((F.col("declares") == "self") & (F.col("m") == j)), F.when(F.col("m") == j, F.col("own_tag")).otherwise(F.lit(tag)), sibling(j)) for j, tag in enumerate(("en", "de", "fr", "es"))]
    declared += [
        entry(some & F.expr("p % 17 = 6"), F.lit("it"), F.concat(F.lit(f"{SHOP}/it/p"), "f")), entry(some & F.expr("p % 19 = 8"), F.lit("pt"), F.concat(F.lit("https://elsewhere.example/pt/p"), "f")),
        entry(some & F.expr("p % 5 = 0"), F.lit("x-default"), sibling(0)),
    ]
    blocks = F.struct(F.lit(True).alias("heading"), "form", F.col("table_").alias("table"), "media", F.lit(True).alias("list"))
    content = F.struct(
        "is_html", "isolated", F.col("digest").alias("text_digest"), F.lit(300).alias("text_length"), _arr(F.when(F.col("marked"), F.lit("lorem_ipsum"))).alias("markers"), blocks.alias("blocks"),
    )
    directives = F.when(F.col("meta_robots") == "googlebot", F.array(F.lit("none"))).otherwise(F.array(F.lit("noindex"), F.lit("follow")))
    meta = F.when(F.col("meta_robots").isNotNull(), F.array(F.struct(F.when(F.col("meta_robots") != "robots", F.col("meta_robots")).alias("crawler"), directives.alias("directives")))).otherwise(F.array().cast(S.ROBOTS_META))
    metadata = F.struct("title", "description", _arr("canonical", "second").alias("canonicals"), meta.alias("robots"))
    two = _arr(F.lit(f"{SHOP}/a.png"), F.lit(f"{SHOP}/b.png"))
    none = F.array().cast("array<string>")
    images = F.struct(
        F.lit(3).alias("total"), "undimensioned", "legacy", F.when(F.col("undimensioned") > 0, two).otherwise(none).alias("undimensioned_urls"),
        F.when(F.col("legacy") > 0, F.slice(two, 1, 1)).otherwise(none).alias("legacy_urls"), F.array("image").alias("urls"),
    )
    headers = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("x-content-type-options").alias("key"), F.col("sniff").alias("value")), F.when(F.col("hsts").isNotNull(), F.struct(F.lit("strict-transport-security").alias("key"), F.col("hsts").alias("value"))))))
    old, older = F.concat(F.lit(f"{SHOP}/old/"), "p"), F.concat(F.lit(f"{SHOP}/older/"), "p")
    hop = lambda url, status, to: F.struct(url.alias("url"), F.lit(status).alias("status"), to.alias("location"))
    chain = (
        F.when(F.col("route") == "chain", F.array(hop(old, 301, older), hop(older, 302, F.col("url")))).when(F.col("route") == "loop", F.array(hop(old, 301, older), hop(older, 302, old)))
        .when(F.col("route") == "slash", F.array(hop(F.concat(old, F.lit("/")), 301, old), hop(old, 301, F.col("url"))))
    )
    return facts.select(
        F.lit("shop").alias("run_id"), "url", F.col("status").alias("http_status"), F.col("err").alias("fetch_error"), F.map_from_entries(F.array_compact(F.array(*declared))).alias("hreflang"),
        _arr("link_next", "link_half", "link_deep", "link_out", "link_old").alias("links"), content.alias("content"), metadata.alias("metadata"), images.alias("images"), F.col("x_robots").alias("x_robots_tag"),
        headers.alias("security_headers"), F.coalesce(chain, F.array().cast(f"array<{S.HOP}>")).alias("redirect_chain"),
    )


def _robots_rules(spark: SparkSession) -> DataFrame:
    return robots.parse(spark.createDataFrame([("shop", ROBOTS_TXT)], "run_id string, body string"))


def _entries(facts: DataFrame) -> DataFrame:
    """A sitemap's text, read back by the library."""
    raw = F.concat(F.col("url"), F.lit("/x?from=map"))
    locs = F.flatten(F.array(
        F.when(F.expr("p % 3 <> 2 and p % 45 <> 1"), F.array("url")).otherwise(F.array()), F.when(F.expr("p % 3 = 1"), F.array(raw)).otherwise(F.array()),
        F.when(F.expr("p % 40 = 0"), F.array(F.concat(F.lit("https://cdn.example/"), "p"))).otherwise(F.array()), F.when(F.expr("p % 90 = 0"), F.array(F.concat(F.lit("ftp://bad/"), "p"))).otherwise(F.array()),
    ))
    text = F.concat(F.lit("<urlset>"), F.array_join(F.transform(locs, lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    return sitemap.parse(facts.select(F.lit("shop").alias("run_id"), text.alias("text"))).select("run_id", "raw", "url")


def _tables(spark: SparkSession, sf_dir: str) -> rules.Crawl:
    facts = stored(_facts(spark, sf_dir), rules.FILE_ROWS)
    named = lambda df, *columns: df.select(F.lit("shop").alias("run_id"), *columns)
    run = spark.range(1).select(
        F.lit("shop").alias("run_id"), F.lit(f"{SHOP}/").alias("base"), F.lit(True).alias("crawl_complete"), F.lit(False).alias("scope_narrowed"), F.lit(f"{SHOP}/").alias("entry_url"),
        F.array(*map(F.lit, ("en", "de", "fr", "it"))).alias("expected_locales"), *(F.array().cast("array<string>").alias(n) for n in ("include_paths", "exclude_paths", "requested")),
        *(F.lit(True).alias(n) for n in ("external_complete", "weights_complete", "render_complete")), F.lit("sitemap.xml").alias("sitemap_source"), F.lit("robots").alias("sitemap_discovery"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("now"),
    )
    out = spark.range(97).select(F.col("id").alias("k"))
    kind = F.col("k") % 10
    external = named(
        out, F.concat(F.lit("https://out.example/e"), "k").alias("url"), F.when(kind == 3, 404).when(kind == 4, 410).when(kind == 5, 500).when(~kind.isin(6, 7), 200).alias("http_status"),
        F.when(kind.isin(6, 7), F.lit("dns")).alias("fetch_error"), (kind == 6).alias("confirmed"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    certificates = named(
        s, F.concat(F.lit("https://c"), "s", F.lit(".example")).alias("origin"), F.lit("Authority").alias("issuer"), F.concat(F.lit("c"), "s").alias("subject"), F.lit(None).cast("timestamp").alias("valid_from"),
        F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, cast(s % 80 - 20 as int))").alias("valid_to"), F.when(F.col("s") % 7 == 0, F.lit("ERR_TLS_CERT_ALTNAME_INVALID")).when(F.col("s") % 11 == 0, F.lit("SELF_SIGNED")).alias("authorization_error"),
    )
    observations = named(
        facts.where("p % 9 = 2"), "url", F.expr("cast(p % 4000 as int)").alias("ttfb_ms"), F.expr("cast(case when p % 5 <> 0 then p % 7000 end as int)").alias("lcp_ms"), F.lit("0.05").alias("cls"), F.expr("cast(p % 6 as int)").alias("first_party_errors"),
        F.expr("cast(p % 4 as int)").alias("third_party_errors"), F.array(F.concat(F.lit("failed "), "p")).alias("messages"), F.when(F.expr("p % 27 = 2"), F.lit("crashed")).alias("render_error"),
    )
    region = F.array(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("width"), F.lit(4).alias("height")))
    visual = named(
        facts.where("p % 8 = 3"), "url", F.expr("p % 16 <> 3").alias("comparable"), F.when(F.expr("p % 16 = 3"), F.lit("masks_differ")).alias("reason"), F.expr("p % 1000").alias("changed_pixels"), F.lit(1_000_000).cast("long").alias("compared_pixels"),
        region.alias("regions"), F.lit(False).alias("regions_capped"), F.lit(0).alias("height_delta"),
    )
    again = named(facts.where("seen_again"), "url", F.col("again_status").alias("http_status"), F.col("again_err").alias("fetch_error"), "confirmed")
    weights = named(spark.range(30), F.concat(F.lit(f"{SHOP}/img/"), "id", F.lit(".jpg")).alias("url"), (F.col("id") * 30_000).alias("bytes"))
    entries = stored(_entries(facts), rules.FILE_ROWS)
    return rules.Crawl(
        spark, _pages(facts), run, kept={"shop_facts": facts}, reverified=again, external=external, image_weights=weights, sitemap=entries, robots=_robots_rules(spark), certificates=certificates,
        observations=observations, visual=visual,
    )


_CRAWLS: dict = {}


def shop(spark: SparkSession, sf_dir: str) -> rules.Crawl:
    """The shop's crawl; its shared tables serve all queries of a session, and are written again where one is gone."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _CRAWLS or not present(*_CRAWLS[key].written()):
        _CRAWLS.clear()
        _CRAWLS[key] = _tables(spark, sf_dir)
    return _CRAWLS[key]


def _rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.RULES[name](shop(spark, sf_dir)).select("url", "detail")

    run.__name__ = f"rule_{name}"
    run.__doc__ = rules.RULES[name].__doc__
    return run


for _name in S.RULES:
    query(EXPECTED[_name])(_rule(_name))
