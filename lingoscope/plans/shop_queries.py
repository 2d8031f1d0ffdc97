"""The library's other operators over the made-up shop (see rule_queries), with what SQL says they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions import bands, headers, html, urls
from lingoscope.operators.ordering import numbered
from lingoscope.plans import findings, reports, runs, variants
from lingoscope.plans.catalogue import joined, query, table
from lingoscope.plans.rule_queries import _BASE, ENTRY, LINK, PG, ROBOTS_TXT, SHOP, _entries, _facts, _sql, _url, parts, shop
from lingoscope.sources import pages as fetched
from lingoscope.sources import robots, sitemap

_SEP = "'|'"


@query(_sql(*_BASE, select="SELECT url, locale, group_key FROM fam"))
def shop_families(spark, sf_dir):
    return shop(spark, sf_dir).family.select("url", "locale", "group_key")


@query(_sql(PG, LINK, select="SELECT pg.url, count(src) AS inbound FROM pg LEFT JOIN link ON dst = pg.url GROUP BY pg.url"))
def shop_inbound(spark, sf_dir):
    return variants.inbound_links(shop(spark, sf_dir).recorded).select("url", "inbound")


_USABLE = "usable AS (SELECT fam.url, locale, count(src) AS inbound FROM fam LEFT JOIN link ON dst = fam.url WHERE err IS NULL AND status < 400 AND is_html GROUP BY ALL)"


@query(_sql(*_BASE, LINK, _USABLE,
    "turn AS (SELECT url, ix, row_number() OVER (PARTITION BY ix ORDER BY inbound DESC, url) AS depth FROM usable, (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'it')) e(ix, l) WHERE locale = l OR locale LIKE l || '-%')",
    f"every AS (SELECT {_url('1')} AS url, 0 AS phase, 0 AS depth, 0 AS ix WHERE {_url('1')} IN (SELECT url FROM usable) UNION ALL SELECT url, 1, depth, ix FROM turn UNION ALL SELECT url, 2, row_number() OVER (ORDER BY inbound DESC, url), 0 FROM usable)",
    select="SELECT url, CAST(row_number() OVER (ORDER BY phase, depth, ix) AS INTEGER) AS place FROM (SELECT url, min((phase, depth, ix)) AS t, t[1] AS phase, t[2] AS depth, t[3] AS ix FROM every GROUP BY url) QUALIFY place <= 12"))
def shop_render_sample(spark, sf_dir):
    c = shop(spark, sf_dir)
    first = F.expr(_url("1").replace("AS VARCHAR(20)", "AS STRING"))
    return variants.render_sample(c.recorded, c.runs.withColumn("entry_url", first), 12).select("url", "place")


#: Findings in the shop that share their causes: by type, number of page and origin.
_FOUND = (
    "found AS (SELECT * FROM (SELECT p * 4 + 1 AS ord, 'link_broken' AS type, [url, nxt] AS origin, 'site' AS space FROM src WHERE p % 5 = 0 UNION ALL SELECT p * 4 + 2, 'canonical_conflicting', [url], 'site' FROM src WHERE p % 6 < 2 "
    "UNION ALL SELECT p * 4 + 3, 'link_external_broken', [url], 'external' FROM src WHERE p % 9 = 1 UNION ALL SELECT p * 4, 'page_orphaned', CAST([] AS VARCHAR[]), 'site' FROM src WHERE p % 11 = 1))"
)
_SRC = "src AS (SELECT p, url, CASE WHEN p % 10 = 0 THEN 'https://gone.example/' || p ELSE link_next END AS nxt, url AS own FROM pg)"
_KEYED = (
    "looked AS MATERIALIZED (SELECT ord, o, group_key FROM (SELECT ord, unnest(origin) AS o FROM found) LEFT JOIN fam ON fam.url = o), "
    "keyed AS MATERIALIZED (SELECT found.ord, type, list_sort(list_distinct(origin)) AS origin, space, k.unknown, CASE WHEN k.unknown THEN list_sort(list_distinct(origin)) ELSE k.families END AS members FROM found "
    "JOIN (SELECT ord, bool_or(group_key IS NULL) AS unknown, list_sort(list(DISTINCT group_key) FILTER (group_key IS NOT NULL)) AS families FROM looked GROUP BY ord) k USING (ord)), "
    "problem AS MATERIALIZED (SELECT space, unknown, members, CASE WHEN unknown THEN 'same-pages' WHEN len(members) = 1 THEN 'one-family' ELSE 'family-set' END AS shape, count(*) AS n, list_sort(list(ord)) AS ords, list_sort(list(DISTINCT type)) AS types FROM keyed GROUP BY ALL HAVING count(*) >= 2)"
)


def _found(spark, sf_dir) -> DataFrame:
    src = _facts(spark, sf_dir).select("p", "url", F.when(F.col("p") % 10 == 0, F.concat(F.lit("https://gone.example/"), "p")).otherwise(F.col("link_next")).alias("nxt"))

    def some(test: str, add: int, name: str, url: Column, /, **detail) -> Column:
        found = F.struct(F.lit("shop").alias("run_id"), (F.col("p") * 4 + add).alias("ord"), F.lit(name).alias("type"), url.alias("url"), F.to_json(F.struct(*(v.alias(k) for k, v in detail.items()))).alias("detail"))
        return F.when(F.expr(test), found)

    none = F.lit(None).cast("string")
    found = [
        some("p % 5 = 0", 1, "link_broken", none, target=F.lit(f"{SHOP}/gone"), linkedFrom=F.array("url", "nxt")),
        some("p % 6 < 2", 2, "canonical_conflicting", F.col("url"), kind=F.lit("multiple"), url=F.col("url"), canonicals=F.array(F.lit("x"), F.lit("y"))),
        some("p % 9 = 1", 3, "link_external_broken", none, target=F.lit("https://out.example/"), linkedFrom=F.array("url")),
        some("p % 11 = 1", 0, "page_orphaned", none, urls=F.array("url")),
    ]
    return src.select(F.inline(F.array_compact(F.array(*found))))


@query(_sql(*_BASE, _SRC, _FOUND, _KEYED, select="""SELECT shape, n, array_to_string(ords, '|') AS findings, array_to_string(types, '|') AS types, array_to_string(members, '|') AS members FROM problem"""))
def shop_problems(spark, sf_dir):
    rows = reports.problems(reports.correlate(_found(spark, sf_dir), shop(spark, sf_dir).family))
    return rows.select("shape", F.size("findings").cast("long").alias("n"), joined(F.col("findings")).alias("findings"), joined(F.col("types")).alias("types"), joined(F.col("problem.members")).alias("members"))


@query(_sql(*_BASE, _SRC, _FOUND, _KEYED, select="""SELECT found.ord, type, shape, coalesce(n, 0) AS size FROM found LEFT JOIN (SELECT unnest(ords) AS ord, shape, n FROM problem) USING (ord)"""))
def shop_correlated(spark, sf_dir):
    """Every finding with its problem's shape, or none: the remainder keeps its order."""
    rows = reports.correlate(_found(spark, sf_dir), shop(spark, sf_dir).family)
    return rows.select("ord", "type", "shape", F.coalesce("size", F.lit(0)).alias("size"))


@query(_sql(*_BASE, _SRC, _FOUND, _KEYED, select="""SELECT array_to_string(members, '|') AS members, n AS findings, c AS new, CASE WHEN c > 0 AND c < n THEN c || ' of ' || n || ' new since the previous run' END AS sentence
    FROM (SELECT space, unknown, members, n, len(list_filter(ords, lambda o: o % 3 = 0)) AS c FROM problem)"""))
def shop_spread(spark, sf_dir):
    found = _found(spark, sf_dir)
    statuses = found.select("run_id", "ord", F.when(F.col("ord") % 3 == 0, "new").otherwise("still_present").alias("status"))
    out = reports.spread(reports.correlate(found, shop(spark, sf_dir).family), statuses)
    return out.select(joined(F.col("problem.members")).alias("members"), "findings", "new", "sentence")


@query(_sql(*_BASE, _SRC, _FOUND, select="""SELECT type, count(DISTINCT ord) AS findings, count(DISTINCT page) AS pages, min(ord) AS first FROM
    (SELECT ord, type, unnest(CASE type WHEN 'link_broken' THEN list_concat(origin, ['https://shop.example/gone']) WHEN 'canonical_conflicting' THEN list_concat(origin, ['x', 'y']) WHEN 'link_external_broken' THEN list_concat(origin, ['https://out.example/']) ELSE [own] END) AS page
     FROM found JOIN src ON src.p = found.ord // 4) GROUP BY type"""))
def shop_findings_by_type(spark, sf_dir):
    return reports.by_type(_found(spark, sf_dir)).select("type", "findings", "pages", "first")


def _samples(spark, sf_dir) -> DataFrame:
    """One finding of a type for each page, its detail as rules write it."""
    names = F.array(*map(F.lit, ("missing_locale", "metadata_duplicated", "canonical_target_broken", "page_orphaned", "sitemap_url_failed", "robots_blocks_indexable", "redirect_chain", "of_the_future", "content_untranslated", "hreflang_target_failed")))
    facts = _facts(spark, sf_dir).withColumn("type", F.get(names, (F.col("p") % 10).cast("int")))
    pair = F.array("link_next", "url")
    detail = F.to_json(F.struct(
        "url", F.col("link_half").alias("groupKey"), F.col("loc").alias("missingLocale"), F.lit("title").alias("field"), F.col("loc").alias("language"), F.col("title").alias("value"), F.col("link_next").alias("canonical"),
        F.lit("placeholder_markers").alias("kind"), pair.alias("urls"), pair.alias("memberUrls"), F.array(F.struct(F.col("link_next").alias("normalised"), "p"), F.struct(F.col("url").alias("normalised"), "p")).alias("entries"), F.lit("/a").alias("rule"),
        F.lit("googlebot").alias("userAgentGroup"), F.col("link_half").alias("from"), F.when(F.col("p") % 20 == 6, F.array("url")).otherwise(F.array()).alias("linkedFrom"), F.col("url").alias("declaredBy"), F.col("loc").alias("locale"), F.col("link_next").alias("target"),
    ))
    return facts.select("p", "type", "url", detail.alias("detail"))


_PAIR = "list_sort([link_next, url])"


@query(_sql(PG, select=f"""SELECT p, CASE p % 10 WHEN 0 THEN 'missing_locale|' || link_half || '|' || loc WHEN 1 THEN 'metadata_duplicated|title|' || loc || '|' || coalesce(title, '') WHEN 2 THEN 'canonical_target_broken|' || url || '|' || link_next
    WHEN 3 THEN 'page_orphaned|' || array_to_string({_PAIR}, ',') WHEN 4 THEN 'sitemap_url_failed|' || array_to_string({_PAIR}, ',') WHEN 5 THEN 'robots_blocks_indexable|/a|googlebot' WHEN 6 THEN 'redirect_chain|' || link_half
    WHEN 7 THEN 'of_the_future|' || url WHEN 8 THEN 'content_untranslated|placeholder_markers|' || link_half || '|' || url ELSE 'hreflang_target_failed|' || url || '|' || loc || '|' || link_next END AS identity FROM pg"""))
def shop_identity(spark, sf_dir):
    key = findings.identity(F.col("type"), F.col("detail"), F.lit(None).cast("string"))
    return _samples(spark, sf_dir).select("p", F.translate(key, "\u0000\u0001", "|,").alias("identity"))


_BOTH = "[link_next, url]"


@query(_sql(PG, f"""roles AS (SELECT p, CASE p % 10 WHEN 0 THEN {_BOTH} WHEN 1 THEN {_BOTH} WHEN 2 THEN [link_next] WHEN 3 THEN {_BOTH} WHEN 4 THEN {_BOTH} WHEN 5 THEN {_BOTH} WHEN 6 THEN CASE WHEN p % 20 = 6 THEN [] ELSE [link_half] END WHEN 7 THEN [url]
    WHEN 8 THEN list_distinct([url, link_next]) ELSE [link_next] END AS subject, CASE p % 10 WHEN 0 THEN {_BOTH} WHEN 1 THEN {_BOTH} WHEN 2 THEN [url] WHEN 3 THEN [] WHEN 4 THEN [] WHEN 5 THEN [] WHEN 6 THEN CASE WHEN p % 20 = 6 THEN [url] ELSE [] END WHEN 7 THEN [url]
    WHEN 8 THEN [url, link_next] ELSE [url] END AS origin FROM pg)""",
    select="SELECT p, array_to_string(list_sort(subject), '|') AS subject, array_to_string(list_sort(origin), '|') AS origin, array_to_string(list_sort(list_distinct(list_concat(origin, subject))), '|') AS pages FROM roles"))
def shop_evidence(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("e", findings.roles(F.col("type"), F.col("detail")))
    return rows.select("p", *(joined(F.array_sort(x)).alias(n) for n, x in (("subject", F.col("e.subject")), ("origin", F.col("e.origin")), ("pages", findings.pages_involved(F.col("e"))))))


@query(_sql(PG, ENTRY, select="""SELECT part, count(*) AS n, min(raw) AS first FROM (SELECT raw, CASE WHEN url IS NULL THEN 'unusable' WHEN url NOT LIKE 'https://shop.example/%' THEN 'cross_origin'
    WHEN url LIKE 'https://shop.example/de/p1%' OR NOT (url LIKE 'https://shop.example/de/%' OR url LIKE 'https://shop.example/en/%') THEN 'out_of_scope' ELSE 'comparable' END AS part FROM entry) GROUP BY part"""))
def shop_sitemap_parts(spark, sf_dir):
    c = shop(spark, sf_dir)
    narrowed = c.runs.withColumns({"include_paths": F.array(F.lit("/de"), F.lit("/en/")), "exclude_paths": F.array(F.lit("/de/p1"))})
    return sitemap.reconciled(c.sitemap, narrowed).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("first"))


_ROBOTS_LINES = ROBOTS_TXT.replace("\n", "~")


@query(f"""WITH body AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 3 = 0 THEN 'Disallow: /early~' ELSE '' END || replace('{_ROBOTS_LINES}', 'p1', 'p' || p_partkey) AS text FROM part),
    line AS (SELECT p, unnest(string_split(text, '~')) AS raw, generate_subscripts(string_split(text, '~'), 1) AS nth FROM body),
    part_ AS (SELECT p, nth, trim(raw) AS line, lower(trim(split_part(regexp_replace(raw, '#.*$', ''), ':', 1))) AS field, trim(substr(regexp_replace(raw, '#.*$', ''), strpos(raw, ':') + 1)) AS value FROM line WHERE strpos(regexp_replace(raw, '#.*$', ''), ':') > 0),
    kept AS (SELECT *, lag(field, 1, '') OVER (PARTITION BY p ORDER BY nth) AS before FROM part_ WHERE field IN ('user-agent', 'allow', 'disallow') AND value <> ''),
    grouped AS (SELECT *, sum(CASE WHEN field = 'user-agent' AND before <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY nth) AS ix FROM kept)
    SELECT r.p, CAST(r.ix AS INTEGER) AS group_ix, r.field AS kind, r.value AS pattern, r.line, CAST(r.nth AS INTEGER) AS line_number, strpos(r.value, '?') = 0 AS evaluable, a.agents FROM grouped r
    JOIN (SELECT p, ix, string_agg(lower(value), '|' ORDER BY nth) AS agents FROM grouped WHERE field = 'user-agent' GROUP BY p, ix) a USING (p, ix) WHERE r.field <> 'user-agent'""")
def shop_robots_rules(spark, sf_dir):
    """Rules of a robots.txt for each part, some with a rule before any agent, some with other line ends."""
    p = F.col("p_partkey").cast("string")
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Disallow: /early\n").otherwise(""), F.replace(F.lit(ROBOTS_TXT), F.lit("p1"), F.concat(F.lit("p"), p)))
    body = F.when(F.col("p_partkey") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    rules = robots.parse(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), body.alias("body")))
    return rules.select(F.col("run_id").alias("p"), F.col("group_ix").cast("int"), "kind", "pattern", "line", "line_number", "evaluable", joined(F.col("user_agents")).alias("agents"))


@query("""WITH f AS (SELECT p_partkey AS p, CAST(p_partkey % 3 AS INTEGER) AS picture, p_partkey % 4 = 0 AS sized, p_partkey % 5 = 0 AS again FROM part)
    SELECT p, 2 + CAST(picture > 0 AS INTEGER) AS total, CAST(NOT sized AND NOT again AS INTEGER) + 1 AS undimensioned, 1 + CAST(picture = 1 AS INTEGER) AS legacy,
    array_to_string(list_sort(list_filter(['https://img.example/a/' || p || '.png', CASE WHEN picture > 0 THEN 'https://img.example/pic.jpg' END, 'https://img.example/x.webp'], lambda u: u IS NOT NULL)), '|') AS urls FROM f""")
def shop_images(spark, sf_dir):
    """Relative addresses, a srcset, an address used twice, a picture with or without a modern source."""
    p, picture = F.col("p").cast("string"), F.col("p") % 3
    size = F.when(F.col("p") % 4 == 0, F.lit(" width=1 height='2'")).otherwise(F.lit(" width=1"))
    markup = F.concat(
        F.lit("<body><IMG alt='' src='/a/"), p, F.lit(".png?v=1'"), size, F.lit("><img srcset='x.webp 1x, y.webp 2x'><img src='data:image/gif;base64,x'>"),
        F.when(F.col("p") % 5 == 0, F.concat(F.lit("<img src=https://IMG.example:443/a/"), p, F.lit(".png#top width=3 height=4>"))).otherwise(F.lit("")),
        F.when(picture == 1, F.lit("<picture><source srcset='pic.gif'><img src='pic.jpg' width=1 height=1></picture>")).when(picture == 2, F.lit("<picture><source type='image/avif' srcset='z'><img src='pic.jpg' width=1 height=1></picture>")).otherwise(F.lit("")),
    )
    rows = parts(spark, sf_dir).select("p", markup.alias("html"), F.lit("https://img.example/page").alias("url"))
    return html.images(rows, ["p"]).select("p", "images.total", "images.undimensioned", "images.legacy", joined(F.array_sort("images.urls")).alias("urls"))


@query("""WITH RECURSIVE hop AS (SELECT 'u' || p_partkey AS src, 'u' || CASE WHEN p_partkey % 16 = 5 THEN p_partkey - 4 ELSE p_partkey + 1 END AS dst FROM part WHERE p_partkey % 16 NOT IN (0, 7) AND p_partkey % 64 < 48 OR p_partkey % 64 >= 48),
    walk(start, here, n, route, over) AS (SELECT 'u' || p_partkey, 'u' || p_partkey, 0, ['u' || p_partkey], CAST(NULL AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT start, CASE WHEN list_contains(route, dst) OR n >= 10 THEN here ELSE dst END, n + 1, CASE WHEN NOT list_contains(route, dst) AND n >= 10 THEN route ELSE list_append(route, dst) END, CASE WHEN list_contains(route, dst) THEN 'Redirect loop.' WHEN n >= 10 THEN 'Too many redirects.' END FROM walk JOIN hop ON hop.src = here WHERE over IS NULL)
    SELECT start AS url, array_to_string(route, '>') AS route, CASE WHEN over IS NULL THEN here END AS final, over AS error FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC) = 1""")
def shop_redirect_routes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    hops = p.where("p % 16 not in (0, 7) and p % 64 < 48 or p % 64 >= 48").select(F.lit("r").alias("run_id"), name(F.col("p")).alias("src"), name(F.when(F.col("p") % 16 == 5, F.col("p") - 4).otherwise(F.col("p") + 1)).alias("dst"))
    out = fetched.redirect_routes(hops, p.where("p % 3 = 0").select(F.lit("r").alias("run_id"), name(F.col("p")).alias("url")))
    return out.select("url", joined(F.col("route"), ">").alias("route"), "final", "error")


@query(_sql(PG, select=f"""SELECT p, 'Café & "' || p || '" – it''s &odd;' AS title, CASE WHEN p % 3 = 0 THEN 'On ' || p END AS description, 'de>{SHOP}/de/p' || f || '|en>{SHOP}/en|x-default>{SHOP}/' AS hreflang,
    '{SHOP}/a/b ' || '{SHOP}/up/' || p || ' https://out.example/q' AS links, CASE WHEN p % 2 = 0 THEN '{SHOP}/c/' || p ELSE '' END AS canonicals, CASE WHEN p % 4 = 1 THEN 'NULL:noindex,follow|googlebot:none' ELSE '' END AS robots,
    p % 5 <> 0 AS isolated, CASE WHEN p % 5 = 0 THEN 22 + CASE p % 6 WHEN 1 THEN 11 WHEN 2 THEN 10 ELSE 22 END ELSE 5 END + length(CAST(p AS VARCHAR)) AS text_length, CASE p % 6 WHEN 1 THEN 'lorem_ipsum' WHEN 2 THEN 'unrendered_expression' ELSE '' END AS markers,
    'x-frame-options=DENY' AS headers, CASE WHEN p % 7 = 0 THEN 'noindex' END AS x_robots FROM pg"""))
def shop_crawled(spark, sf_dir):
    """Facts of made-up HTML: entities, relative addresses, both kinds of region, placeholders, headers."""
    p = F.col("p").cast("string")
    facts = _facts(spark, sf_dir)
    main = F.when(F.col("p") % 5 != 0, F.concat(F.lit("<MAIN id=m>On\n "), p, F.lit("<script>var x = '<main>'</script>!</main>"))).otherwise(F.concat(F.lit("<p>on "), p, F.lit("</p><article>a</article><article>b</article>")))
    marked = F.when(F.col("p") % 6 == 1, F.lit("<footer>Lorem <b>ipsum</b></footer>")).when(F.col("p") % 6 == 2, F.lit("<i>{{ name }}</i>")).otherwise(F.lit("<code>{{ kept }} lorem ipsum</code>"))
    markup = F.concat(
        F.lit("<html><head><title>\n Caf&#xE9; &amp; &quot;"), p, F.lit("&quot; &#8211; it&#39;s   &odd;</title>"), F.when(F.col("p") % 3 == 0, F.concat(F.lit("<meta NAME=description content='On "), p, F.lit("'><meta name=description content=two>"))).otherwise(F.lit("")),
        F.lit("<link rel=alternate hreflang=\"DE\" href=\"/de/p"), F.col("f").cast("string"), F.lit("/\"><link rel='alternate' hreflang='en' href='/old'><link rel='alternate' hreflang='x-default' href='"), F.lit(SHOP), F.lit("#x'><link rel='alternate' hreflang=fr href='/fr'><link rel=\"alternate stylesheet\" hreflang='en' href='../en?x=1'>"),
        F.when(F.col("p") % 2 == 0, F.concat(F.lit("<link rel='shortcut Canonical' href=c/"), p, F.lit("><link rel=canonical href='/c/"), p, F.lit("?a'>"))).otherwise(F.lit("")),
        F.when(F.col("p") % 4 == 1, F.lit("<meta name=robots content='NoIndex, follow,,noindex'><meta name='googlebot' content=none><meta name=other content=noindex>")).otherwise(F.lit("")),
        F.lit("</head><body>"), main, marked, F.lit("<nav><a href='./a//../a/b/'>1</a><a class=x href=\"mailto:x@y\">2</a><a href=unquoted>3</a><a href='/up/x/../"), p, F.lit("#f'>4</a><a href='https://OUT.example:443/q/?z'>5</a><a href='/a/b'>6</a><a href='ftp://f/'>7</a></nav></body></html>"),
    )
    sent = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("x-frame-options").alias("key"), F.lit("DENY").alias("value")), F.when(F.col("p") % 7 == 0, F.struct(F.lit("x-robots-tag").alias("key"), F.lit("noindex").alias("value"))), F.struct(F.lit("server").alias("key"), F.lit("s").alias("value")))))
    rows = facts.select(F.concat(F.lit("r"), p).alias("run_id"), F.lit(f"{SHOP}/Index").alias("url"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("fetch_error"), F.lit("Text/HTML; charset=utf-8").alias("content_type"), sent.alias("headers"), markup.alias("html"))
    out = fetched.crawled(rows)
    pairs = F.transform(F.array_sort(F.map_entries("hreflang")), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    told = F.transform("metadata.robots", lambda r: F.concat(F.coalesce(r["crawler"], F.lit("NULL")), F.lit(":"), F.array_join(r["directives"], ",")))
    return out.select(
        F.substring("run_id", 2, 20).cast("long").alias("p"), "metadata.title", "metadata.description", joined(pairs).alias("hreflang"), joined(F.col("links"), " ").alias("links"), joined(F.col("metadata.canonicals")).alias("canonicals"), joined(told).alias("robots"),
        "content.isolated", F.col("content.text_length").cast("long").alias("text_length"), joined(F.col("content.markers")).alias("markers"), joined(F.transform(F.map_entries("security_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("headers"), F.col("x_robots_tag").alias("x_robots"),
    )


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS a, o_orderkey % 5 AS b, o_orderkey % 3 AS c FROM orders)
    SELECT k, CASE WHEN a = 0 THEN 'not_recorded' WHEN a = 1 THEN 'unavailable' WHEN b = 0 OR c + a - 2 = 0 THEN 'nothing_to_measure' ELSE 'measured' END AS performance,
    CASE WHEN a > 1 AND b <> 0 AND c + a - 2 <> 0 THEN c || CASE WHEN c = 1 THEN ' page' ELSE ' pages' END || ' measured' || CASE WHEN b > 1 THEN ' of ' || (b - 1) || CASE WHEN b = 2 THEN ' page' ELSE ' pages' END || ' crawled' ELSE '' END || CASE WHEN a > 2 THEN '; ' || (a - 2) || ' could not be measured' ELSE '' END END AS coverage,
    CASE WHEN a = 0 THEN 'not_recorded' WHEN a = 1 THEN 'unavailable' WHEN b = 0 AND c = 0 THEN 'no_baseline' WHEN b = 0 THEN 'predates_baseline' WHEN a = 2 OR c = 1 THEN 'nothing_watched' ELSE 'compared' END AS visual,
    CASE WHEN a = 0 THEN 'not_recorded' WHEN a = 1 THEN 'unavailable' WHEN b = 0 THEN 'nothing_measured' ELSE 'sampled' END AS sample, CASE WHEN a = 0 THEN 'not_recorded' WHEN a = 1 THEN 'unavailable' WHEN b = 0 THEN 'no_baseline' WHEN a = 2 THEN 'nothing_watched' ELSE 'watched' END AS pictures,
    CASE WHEN a = 3 THEN 'not_recorded' WHEN b < 2 THEN 'whole_site' ELSE 'narrowed' END AS scope, CASE WHEN c = 0 THEN 'not_recorded' ELSE 'recorded' END AS rules, CASE WHEN c > 0 THEN c END AS rule_count FROM r""")
def shop_run_states(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = k.select("k", *((F.col("k") % n).cast("int").alias(x) for x, n in (("a", 7), ("b", 5), ("c", 3))))
    summary = F.when(F.col("a") > 0, F.struct((F.col("a") != 1).alias("complete"), F.col("b").alias("chosen"), F.when(F.col("b") > 0, F.lit("base")).alias("baseline_run_id"), (F.col("a") - 2).alias("watched")))
    some = lambda test: F.when(test, F.array(F.lit("/x"))).otherwise(F.array().cast("array<string>"))
    scope = F.when(F.col("a") != 3, F.struct(some(F.col("b") == 2).alias("include_paths"), some(F.col("b") > 2).alias("exclude_paths")))
    rows = rows.withColumns({"summary": summary, "scope": scope, "rule_set": F.when(F.col("c") > 0, F.array_repeat(F.lit("r"), F.col("c")))})
    state = bands.performance_state(F.col("summary"), F.col("c"), F.greatest(F.col("a") - 2, F.lit(0)), F.greatest(F.col("b") - 1, F.lit(0)))
    told = bands.rules_coverage(F.col("rule_set"))
    return rows.select(
        "k", state["kind"].alias("performance"), state["coverage"].alias("coverage"), bands.visual_state(F.col("summary"), F.when(F.col("c") == 1, 0).otherwise(3), F.when(F.col("c") > 0, F.lit("base"))).alias("visual"),
        bands.sample_coverage(F.col("summary")).alias("sample"), bands.picture_coverage(F.col("summary")).alias("pictures"), bands.scope_coverage(F.col("scope")).alias("scope"), told["kind"].alias("rules"), told["count"].cast("long").alias("rule_count"),
    )


@query("""WITH s AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS k, l_orderkey % 13 = 0 AS crashed, l_orderkey % 17 = 0 AS old, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber <> 4 END AS comparable, CAST(l_quantity AS BIGINT) AS changed, CASE WHEN l_linenumber = 3 THEN 0 ELSE 20000 END AS compared FROM lineitem),
    t AS (SELECT *, CASE WHEN crashed THEN 'could not be photographed' WHEN old THEN 'its picture has expired' WHEN comparable IS NULL THEN 'not compared' WHEN NOT comparable THEN 'masks differ' END AS reason, CASE WHEN comparable AND compared > 0 THEN changed / compared END AS share FROM s)
    SELECT k, reason, share, coalesce(share >= 0.0005, false) AS differs, row_number() OVER (ORDER BY reason IS NOT NULL DESC, CASE WHEN share >= 0.0005 THEN share ELSE -1 END DESC, k) AS place FROM t""")
def shop_snapshots_in_order(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("changed_pixels"))
    n = F.col("l_linenumber")
    rows = line.select(
        "k", "changed_pixels", F.when(F.col("l_orderkey") % 13 == 0, F.lit("crash")).alias("capture_error"), F.when(F.col("l_orderkey") % 17 == 0, F.lit("2026-01-01").cast("date")).alias("expired_at"), F.when(n != 5, n != 4).alias("comparable"),
        F.lit("masks differ").alias("reason"), F.when(n == 3, 0).otherwise(20_000).cast("long").alias("compared_pixels"), F.col("k").alias("url"),
    )
    compared = F.col("comparable"), F.col("changed_pixels"), F.col("compared_pixels")
    reason = bands.uncompared_reason(F.col("capture_error"), F.col("expired_at"), F.col("comparable"), F.col("reason"))
    keep = "k", reason.alias("reason"), bands.change_share(*compared).alias("share"), bands.differs(*compared).alias("differs")
    return numbered(rows, reports.snapshots_order([F.col("url")]), "place", keep=keep)


@query(_sql(PG, select="""SELECT url, CAST(row_number() OVER (ORDER BY p % 27 <> 2, p % 6 DESC, CASE WHEN p % 5 <> 0 THEN p % 7000 ELSE -1 END DESC, url) AS INTEGER) AS place FROM pg WHERE p % 9 = 2"""))
def shop_observations_in_order(spark, sf_dir):
    rows = numbered(shop(spark, sf_dir).observations, reports.observations_order(), "place", keep=("url",))
    return rows.withColumn("place", F.col("place").cast("int"))


@query(_sql(PG, select="""SELECT pg.url, pg.p AS page_id, CAST(round(p * 1.5) AS INTEGER) AS ttfb_ms, CASE WHEN p % 5 <> 0 THEN CAST(round(p * 0.25) AS INTEGER) END AS lcp_ms, '0.1' AS cls FROM pg WHERE p % 4 < 2 AND p % 3 = 0"""))
def shop_recorded_observations(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    pages = facts.where("p % 4 < 2").select(F.lit("r").alias("run_id"), "url", F.col("p").alias("page_id"))
    seen = facts.where("p % 3 = 0").select(F.lit("r").alias("run_id"), "url", (F.col("p") * 1.5).cast("double").alias("ttfb_ms"), F.when(F.col("p") % 5 != 0, (F.col("p") * 0.25).cast("double")).alias("lcp_ms"), F.lit("0.1").cast("double").alias("cls"))
    return runs.recorded_observations(seen, pages).select("url", "page_id", "ttfb_ms", "lcp_ms", "cls")


@query(_sql(PG, select="SELECT p * 2 AS ord, url, CASE WHEN p % 4 < 2 THEN p END AS page_id FROM pg WHERE p % 3 = 0"))
def shop_findings_with_pages(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    pages = facts.where("p % 4 < 2").select(F.lit("r").alias("run_id"), "url", F.col("p").alias("page_id"))
    return runs.with_page_ids(facts.where("p % 3 = 0").select(F.lit("r").alias("run_id"), "url", (F.col("p") * 2).alias("ord")), pages).select("ord", "url", "page_id")


@query("""SELECT o_orderstatus AS was, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' ELSE 'done' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def shop_stale_runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return runs.swept(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("was"), status.alias("status"))).groupBy("was", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS user_id, o_orderkey AS project_id, min(origin) AS origin FROM (SELECT o_custkey AS c_custkey, o_orderkey, 0 AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL""")
def shop_assignments_added(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("project_id"))
    more = rows.where("project_id % 2 = 0").withColumn("origin", F.lit(1))
    return runs.added(rows.where("project_id % 3 = 0").withColumn("origin", F.lit(0)), more.unionByName(more), ["user_id", "project_id"])


@query("""SELECT o_orderkey AS project_id FROM orders WHERE o_custkey % 10 = 1 AND o_orderstatus <> 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 4 = 1)""")
def shop_visible_projects(spark, sf_dir):
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 10).alias("tenant_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived_at"))
    assigned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), (F.col("l_suppkey") % 4).alias("user_id"))
    return runs.visible_projects(projects, assigned, F.lit(1), F.lit(1), F.lit(False)).select("project_id")


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE row_number() OVER (PARTITION BY o_custkey, o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey DESC) END AS nth, o_orderkey % 4 <> 0 AS held FROM orders)
    SELECT k, CASE WHEN coalesce(nth > 3, false) OR NOT held THEN NULL ELSE 'png' END AS picture, coalesce(nth > 3, false) AND held AS stamped FROM s""")
def shop_snapshots_expired(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.startswith("o_orderpriority", F.lit("1")).alias("is_baseline"))
    held = orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 != 0, F.lit("png")).alias("picture"), F.lit(None).cast("timestamp").alias("expired_at"))
    out = runs.expired(held, run, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select(F.col("run_id").alias("k"), "picture", F.col("expired_at").isNotNull().alias("stamped"))


@query(r"""SELECT event_id, array_to_string(list_distinct_in_order, '|') AS selectors, CASE WHEN len(list_distinct_in_order) > 50 THEN 'too_many' WHEN event_id % 40 = 3 THEN 'too_long' END AS problem FROM
    (SELECT event_id, list_concat(['#a', '.b c'], CASE WHEN event_id % 40 = 3 THEN [repeat('x', 256)] WHEN event_id % 40 = 4 THEN list_transform(range(60), lambda i: 'n' || i) ELSE ['#u' || (event_id % 7)] END) AS list_distinct_in_order FROM events)""")
def shop_mask_selectors(spark, sf_dir):
    k = F.col("event_id")
    last = F.when(k % 40 == 3, F.repeat(F.lit("x"), F.lit(256))).when(k % 40 == 4, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("n"), i.cast("string"))), "\n")).otherwise(F.concat(F.lit("#u"), (k % 7).cast("string")))
    told = bands.mask_selectors(F.concat(F.lit(" #a \n\n.b c\r\n#a\n"), last))
    return table(spark, sf_dir, "events").select("event_id", joined(told["selectors"]).alias("selectors"), told["problem"].alias("problem"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1000 * (event_id % 100) WHEN 1 THEN 90000 WHEN 2 THEN 0 END AS wait_ms, CASE event_id % 3 WHEN 0 THEN CAST(0.125 AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(12 AS DOUBLE) END AS shift, array_to_string(CASE event_id % 4 WHEN 0 THEN ['0'] WHEN 1 THEN ['0', '1'] WHEN 2 THEN ['0', '1', '2'] ELSE ['0', '1', '2'] END, '|') AS shown,
    CAST(greatest(event_id % 4 - 2, 0) AS INTEGER) AS hidden FROM events""")
def shop_small_values(spark, sf_dir):
    """Retry-After, layout shifts that were stored as text, lists with a hidden rest."""
    k = F.col("event_id")
    after = F.when(k % 5 == 0, (k % 100).cast("string")).when(k % 5 == 1, F.lit("Thu, 01 Jan 2026 00:01:30 GMT")).when(k % 5 == 2, F.lit("Wed, 31 Dec 2025 00:00:00 GMT")).otherwise(F.lit("soon"))
    shift = F.when(k % 3 == 0, F.lit("0.125")).when(k % 3 == 1, F.lit("n/a")).otherwise(F.lit("12"))
    part = reports.listed(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: i.cast("string")), 3)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", bands.retry_after_ms(after, now).alias("wait_ms"), bands.cls(shift).alias("shift"), joined(part["shown"]).alias("shown"), part["hidden"].alias("hidden"))


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, event_type || '/' || (user_id % 50) AS target, event_id FROM events), d AS (SELECT day, lag(day) OVER (ORDER BY day) AS before, row_number() OVER (ORDER BY day) % 5 = 0 AS partial FROM (SELECT DISTINCT day FROM f)),
    p AS (SELECT *, CASE WHEN before IS NULL THEN 'no_predecessor' WHEN partial OR lag(partial) OVER (ORDER BY day) THEN 'incomplete_crawl' END AS reason FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY day, target ORDER BY event_id) AS nth FROM f)
    SELECT p.day, coalesce(status, 'not compared') AS status, reason, count(*) AS n FROM p JOIN (
        SELECT c.day, CASE WHEN p.reason IS NULL THEN CASE WHEN o.day IS NULL THEN 'new' ELSE 'still_present' END END AS status FROM n c JOIN p ON p.day = c.day LEFT JOIN n o ON o.day = p.before AND o.target = c.target AND o.nth = c.nth
        UNION ALL SELECT p.day, 'resolved' FROM n o JOIN p ON p.before = o.day AND p.reason IS NULL LEFT JOIN n c ON c.day = p.day AND c.target = o.target AND c.nth = o.nth WHERE c.day IS NULL) USING (day) GROUP BY ALL""")
def shop_compare_runs(spark, sf_dir):
    """Findings of each day against the day before, by identity; partial days are not compared."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = events.select("day").distinct().withColumn("nth", F.row_number().over(Window.orderBy("day")))
    none = F.array().cast("array<string>")
    scope = F.struct(none.alias("include_paths"), none.alias("exclude_paths"), none.alias("locales"))
    run = days.select(F.lit("p").alias("project_id"), F.col("day").cast("string").alias("run_id"), F.col("day").alias("created_at"), (F.col("nth") % 5 != 0).alias("crawl_complete"), scope.alias("scope"), F.array(F.lit("link_broken")).alias("rule_set"))
    detail = F.to_json(F.struct(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("target"), F.col("event_id").alias("seen")))
    found = events.select(F.col("day").cast("string").alias("run_id"), F.col("event_id").alias("ord"), F.lit("link_broken").alias("type"), F.lit(None).cast("string").alias("url"), detail.alias("detail"))
    out = runs.compare_runs(run, found)
    return out.groupBy(F.to_date("run_id").alias("day"), F.coalesce("status", F.lit("not compared")).alias("status"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE doc AS (SELECT 's' || p_partkey AS name, p_partkey % 10 < 3 AS is_index, p_partkey AS p FROM part), child AS (SELECT p, unnest([p * 2, p * 2 + 1]) AS c FROM doc WHERE is_index),
    walk(p, level) AS (SELECT 1, 0 UNION SELECT c, level + 1 FROM walk JOIN child USING (p) WHERE c IN (SELECT p FROM doc) AND level < 50), met AS (SELECT p, min(level) AS level FROM walk GROUP BY p)
    SELECT 'https://shop.example/s' || p AS source, 'https://shop.example/page/' || p AS url FROM met JOIN doc USING (p) WHERE NOT is_index""")
def shop_sitemap_tree(spark, sf_dir):
    """Sitemaps by way of the indexes that name them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    loc = lambda path, n: F.concat(F.lit(f"<loc>{SHOP}/{path}"), n.cast("string"), F.lit("?x&amp;y</loc>"))
    text = F.when(F.col("p") % 10 < 3, F.concat(F.lit("<sitemapindex>"), loc("s", F.col("p") * 2), loc("s", F.col("p") * 2 + 1), F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset>"), loc("page/", F.col("p")), F.lit("</urlset>")))
    bodies = p.select(F.lit("r").alias("run_id"), F.concat(F.lit(f"{SHOP}/s"), F.col("p").cast("string")).alias("sitemap"), text.alias("text"))
    roots = spark.createDataFrame([("r", f"{SHOP}/s1")], "run_id string, sitemap string")
    return sitemap.read_tree(roots, bodies).select("source", "url")


@query(_sql(PG, select="""SELECT p, CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN 'NULL=noindex|NULL=max-snippet: 5|otherbot=nofollow|otherbot=all' WHEN 2 THEN 'googlebot=none|bingbot=noarchive' ELSE 'NULL=unavailable_after: 1 jan' END AS directives,
    CASE p % 4 WHEN 0 THEN 'strict-transport-security' WHEN 1 THEN 'x-content-type-options' WHEN 2 THEN 'referrer-policy' ELSE '' END AS malformed FROM pg"""))
def shop_header_values(spark, sf_dir):
    k = F.col("p") % 4
    told = headers.robots_header(F.when(k == 0, F.lit("")).when(k == 1, F.lit("NoIndex, max-snippet: 5, otherbot: nofollow, ALL")).when(k == 2, F.lit("Googlebot : none, bingbot:noarchive,")).otherwise(F.lit("unavailable_after: 1 Jan")))
    sent = F.when(k == 0, F.array(F.lit("max-ages=3"), F.lit("nosniff"), F.lit("x"))).when(k == 1, F.array(F.lit("MAX-AGE = 3"), F.lit("sniff"), F.lit("x"))).when(k == 2, F.array(F.lit("max-age=0"), F.lit(" NoSniff "), F.lit(" "))).otherwise(F.array(F.lit("max-age=1"), F.lit("nosniff"), F.lit("x")))
    names = ("strict-transport-security", "x-content-type-options", "referrer-policy")
    bad = F.array_compact(F.array(*(F.when(headers.malformed(F.lit(n), F.get("sent", F.lit(i))), F.lit(n)) for i, n in enumerate(names))))
    rows = _facts(spark, sf_dir).select("p", told.alias("told"), sent.alias("sent"))
    return rows.select("p", joined(F.transform("told", lambda d: F.concat(F.coalesce(d["crawler"], F.lit("NULL")), F.lit("="), d["directive"]))).alias("directives"), joined(bad).alias("malformed"))


@query(_sql(PG, select="""SELECT p, CASE p % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS inside FROM pg"""))
def shop_scope(spark, sf_dir):
    """Included prefixes end at a segment, excluded ones anywhere; the root only covers itself."""
    k = F.col("p") % 6
    path = F.when(k == 0, F.lit("/deals")).when(k == 1, F.lit("/de/")).when(k == 2, F.lit("/de/private-area")).when(k == 3, F.lit("/")).when(k == 4, F.lit("/en")).otherwise(F.lit("/de/x"))
    include, exclude = F.array(F.lit("/de"), F.lit("/")), F.array(F.lit("/de/private"))
    return _facts(spark, sf_dir).select("p", urls.in_scope(path, include, exclude).alias("inside"))
