"""Named queries and, where SQL can express them, what DuckDB must give for each.

The queries run the library's operators on the tables at hand: pages as they
are, and events, orders, line items and parts in the roles of runs, findings,
families and patterns.  Lists are joined to strings so that results compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingoscope.functions import bands, html
from lingoscope.functions.locale import LANGUAGES, locale_from_path
from lingoscope.functions.urls import origin_of, page_url, path_of
from lingoscope.operators.graph import connected_components, reachable
from lingoscope.operators.intervals import bursts, stopped_by_rate
from lingoscope.operators.storage import stored
from lingoscope.plans import reports, rules, runs
from lingoscope.schema import FAILURE_BURST, FAILURE_RATE, FAILURE_SAMPLE
from lingoscope.sources.pages import crawled
from lingoscope.sources.robots import verdicts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must agree."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(items: Column, by: str = "|") -> Column:
    return F.array_join(items.cast("array<string>"), by)


# ---------------------------------------------------------------- pages

_TEXT = r"""
    lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), html),
        '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', chr(1), 'g'),
        '(?i)&[a-z]+;|&#[0-9]+;', ' ', 'g'), chr(1), '&'), '\s+', ' ', 'g')))
"""
_URL = r"""
    (regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), CASE WHEN url LIKE 'http:%' THEN ':80$' ELSE ':443$' END, '') ||
     CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN '/'
          ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') END)
"""
_LOCALE = f"""
    CASE WHEN lower(regexp_extract(url, '^https?://[^/?#]+/([A-Za-z]{{2}})(/|$|\\?|#)', 1)) IN ({", ".join(f"'{x}'" for x in LANGUAGES)})
         THEN lower(regexp_extract(url, '^https?://[^/?#]+/([A-Za-z]{{2}})(/|$|\\?|#)', 1)) END
"""
_TITLE = r"""
    nullif(left(trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g')), 1000), '')
"""


def _texts(pages: DataFrame, *columns) -> DataFrame:
    """The columns and (text_length, text_digest); a filter on these doesn't read the text again."""
    return pages.select(*columns, F.inline_outer(F.array(html.text_facts(F.col("html")))))


@query(f"SELECT page_id, CAST(length(t) AS INTEGER) AS text_length, CASE WHEN length(t) >= 200 THEN sha256(t) END AS text_digest FROM (SELECT page_id, {_TEXT} AS t FROM pages)")
def page_content_digest(spark, sf_dir):
    return _texts(table(spark, sf_dir, "pages"), "page_id")


@query(f"""SELECT digest, count(*) AS pages, string_agg(u, '|' ORDER BY u) AS urls FROM
    (SELECT {_URL} AS u, CASE WHEN length(t) >= 200 THEN sha256(t) END AS digest FROM (SELECT url, {_TEXT} AS t FROM pages)) WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) >= 2""")
def content_duplicated(spark, sf_dir):
    rows = _texts(table(spark, sf_dir, "pages"), page_url(F.col("url")).alias("url")).withColumnRenamed("text_digest", "digest").where("digest is not null")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("pages"), joined(F.array_sort(F.collect_list("url"))).alias("urls")).where("pages >= 2")


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"""SELECT language, value, string_agg(u, '|' ORDER BY u) AS urls FROM (SELECT DISTINCT {_URL} AS u, {_LOCALE} AS language, {_TITLE} AS value FROM pages)
    WHERE value IS NOT NULL GROUP BY language, value HAVING count(*) >= 2""")
def metadata_duplicated(spark, sf_dir):
    url = page_url(F.col("url"))
    rows = table(spark, sf_dir, "pages").select(url.alias("url"), locale_from_path(path_of(url)).alias("language"), html.title(F.col("html")).alias("value")).where("value is not null").distinct()
    return rows.groupBy("language", "value").agg(joined(F.array_sort(F.collect_list("url"))).alias("urls"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query(f"SELECT page_id, {_URL} AS normalised FROM pages")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_url(F.col("url")).alias("normalised"))


@query(f"SELECT page_id, {_LOCALE} AS locale FROM pages")
def locale_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", locale_from_path(path_of(F.col("url"))).alias("locale"))


_HREFS = r"""list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda x: x[2:-2])"""


@query(f"SELECT page_id, CAST(len(h) AS INTEGER) AS links, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id, {_HREFS} AS h FROM pages)")
def page_links(spark, sf_dir):
    links = html.raw_links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("links"), joined(links, " ").alias("hrefs"))


@query(f"SELECT href, count(DISTINCT page_id) AS inbound FROM (SELECT page_id, unnest({_HREFS}) AS href FROM pages) GROUP BY href")
def inbound_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.raw_links(F.col("html"))).alias("href"))
    return rows.distinct().groupBy("href").agg(F.count(F.lit(1)).alias("inbound"))


@query(r"""SELECT page_id, regexp_matches(a, '(?i)<h[1-6]\b') AS heading, regexp_matches(a, '(?i)<form\b') AS form, regexp_matches(a, '(?i)<table\b') AS table_,
    regexp_matches(a, '(?i)<(img|video|audio|picture|iframe|figure)\b') AS media, regexp_matches(a, '(?i)<(ul|ol|dl)\b') AS list_
    FROM (SELECT page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS a FROM pages)""")
def block_presence(spark, sf_dir):
    region = html.content_region(F.col("html"))["region"]
    rows = table(spark, sf_dir, "pages").select("page_id", html.blocks(region).alias("b"))
    return rows.select("page_id", "b.heading", "b.form", F.col("b.table").alias("table_"), "b.media", F.col("b.list").alias("list_"))


_EDGES = r"SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, 'p' || regexp_extract(url, '^https?://[^/?#]+/[a-z]+/([0-9]+)', 1) AS part FROM pages"


def _host_parts(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    part = F.concat(F.lit("p"), F.regexp_extract("url", r"^https?://[^/?#]+/[a-z]+/([0-9]+)", 1))
    return pages.select(host.alias("src"), part.alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({_EDGES}), bo AS (SELECT host AS u, part AS v FROM e UNION SELECT part, host FROM e),
    reach(u, v) AS (SELECT u, u FROM bo UNION SELECT reach.u, bo.v FROM reach JOIN bo ON reach.v = bo.u) SELECT u AS node, min(v) AS component FROM reach GROUP BY u""")
def variant_components(spark, sf_dir):
    return connected_components(_host_parts(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), bo AS (SELECT host AS u, part AS v FROM e UNION SELECT part, host FROM e),
    reach(node, depth) AS (SELECT min(host), 0 FROM e UNION SELECT bo.v, depth + 1 FROM reach JOIN bo ON reach.node = bo.u WHERE depth < 6) SELECT node, min(depth) AS depth FROM reach GROUP BY node""")
def frontier_reachability(spark, sf_dir):
    """The first six steps, as the SQL asks (frontier_closure takes all)."""
    e = _host_parts(spark, sf_dir)
    return reachable(e.union(e.select("dst", "src")), e.agg(F.min("src")), max_depth=6)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), bo AS (SELECT host AS u, part AS v FROM e UNION SELECT part, host FROM e),
    reach(node, depth) USING KEY (node) AS (SELECT min(host), 0 FROM e UNION SELECT DISTINCT bo.v, depth + 1 FROM reach JOIN bo ON reach.node = bo.u WHERE bo.v NOT IN (SELECT node FROM recurring.reach)) SELECT node, depth FROM reach""")
def frontier_closure(spark, sf_dir):
    """All that the first host reaches, however far."""
    e = stored(_host_parts(spark, sf_dir))
    return reachable(e.union(e.select("dst", "src")), e.agg(F.min("src")))


@query(f"""WITH p AS (SELECT {_URL} AS u, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {_LOCALE} AS locale, page_id % 7 = 0 AS broken FROM pages),
    fam AS (SELECT host FROM p GROUP BY host HAVING count(*) >= 2), cols(ix, l) AS (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'it')),
    cells AS (SELECT host, ix, coalesce((SELECT min_by(CASE WHEN broken THEN 'broken' ELSE 'present' END, (u, locale, broken)) FROM p WHERE p.host = fam.host AND locale = l), 'missing') AS cell FROM fam, cols),
    grid AS (SELECT host AS group_key, string_agg(cell, '|' ORDER BY ix) AS cells, count(*) FILTER (cell IN ('missing', 'broken')) AS gaps FROM cells GROUP BY host),
    placed AS (SELECT *, row_number() OVER (ORDER BY gaps DESC, group_key) AS place, count(*) OVER () AS total FROM grid WHERE gaps > 0)
    SELECT group_key, cells, CAST(place AS INTEGER) AS place, greatest(total - 14, 0) AS hidden FROM placed WHERE place <= 14""")
def parity_grid(spark, sf_dir):
    url = page_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("r").alias("run_id"), url.alias("url"), locale_from_path(path_of(url)).alias("locale"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("group_key"),
        F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("fetch_error"),
    )
    run = spark.createDataFrame([("r", ["en", "de", "fr", "es", "it"])], "run_id string, expected_locales array<string>")
    return reports.parity(pages, run).select("group_key", joined(F.col("cells")).alias("cells"), "place", "hidden")


@query(rf"""WITH all_ AS (SELECT *, {_URL} AS u, {_LOCALE} AS locale, lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS raw_origin FROM pages),
    page AS (SELECT u, regexp_extract(u, '^(https?://[^/]+)', 1) AS run_id, min_by(page_id, page_id) AS page_id, arg_min(html, page_id) AS html, any_value(locale) AS locale FROM all_ GROUP BY u),
    f AS (SELECT *, page_id % 11 <> 0 AS live, {_TITLE} AS title, {_TEXT} AS t, length(regexp_extract(html, '(?i)(<article\b[^>]*>)', 1)) > 0 AS isolated FROM page),
    ok AS (SELECT * FROM f WHERE live),
    link AS (SELECT DISTINCT run_id, u AS src, run_id || CASE WHEN h = '/' THEN h ELSE regexp_replace(h, '/$', '') END AS dst FROM (SELECT run_id, u, unnest(list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*'')', 1), lambda x: x[2:-2])) AS h FROM f) WHERE regexp_full_match(h, '/[A-Za-z0-9/_-]*')),
    found AS (
        SELECT run_id, 3 AS rule, 'no_hreflang' AS type, u AS url, CAST(to_json({{'url': u, 'impliedLocale': locale}}) AS VARCHAR) AS detail FROM ok WHERE locale IS NOT NULL
        UNION ALL SELECT run_id, 8, 'metadata_missing', u, CAST(to_json({{'url': u, 'fields': list_filter([CASE WHEN title IS NULL THEN 'title' END, 'description'], lambda x: x IS NOT NULL)}}) AS VARCHAR) FROM ok
        UNION ALL SELECT run_id, 9, 'metadata_duplicated', NULL, CAST(to_json({{'field': 'title', 'language': locale, 'value': title, 'urls': urls}}) AS VARCHAR) FROM (SELECT run_id, locale, title, list_sort(list(u)) AS urls FROM ok WHERE title IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
        UNION ALL SELECT run_id, 14, 'content_duplicated', NULL, CAST(to_json({{'digest': sha256(t), 'textLength': CAST(length(t) AS INTEGER), 'urls': urls}}) AS VARCHAR) FROM (SELECT run_id, t, list_sort(list(u)) AS urls FROM ok WHERE isolated AND length(t) >= 200 GROUP BY ALL HAVING count(*) >= 2)
        UNION ALL SELECT run_id, 15, 'link_broken', NULL, CAST(to_json({{'target': dst, 'httpStatus': 404, 'fetchError': CAST(NULL AS VARCHAR), 'confirmed': false, 'linkedFrom': linked}}) AS VARCHAR)
            FROM (SELECT l.run_id, dst, list_sort(list(DISTINCT src)) AS linked FROM link l JOIN f d ON d.run_id = l.run_id AND d.u = dst AND NOT d.live WHERE src <> dst GROUP BY ALL))
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY rule, url NULLS FIRST, detail) AS ord, type, url, detail FROM found""")
def detect_findings(spark, sf_dir):
    """The rules over all pages: a run for each origin, whose every eleventh page is gone.

    Of rows with one address that of the smallest page_id is the page.  The tables
    have no sitemap, robots rules, fetches of other sites or images, certificates,
    browser or picture observations, redirects or headers; the rules that read
    those (certificate_problem, security_header_contradiction, sitemap_url_failed,
    page_missing_from_sitemap, robots_blocks_indexable, link_external_broken,
    redirect_chain, image_oversized, console_error, visual_changed, and the
    X-Robots-Tag in noindex_present) have nothing to judge here.
    """
    fetched = _one_of_each_address(table(spark, sf_dir, "pages")).select(
        "run_id", "url", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("fetch_error"),
        F.lit("text/html").alias("content_type"), F.create_map().cast("map<string,string>").alias("headers"), "html",
    )
    base, none = F.concat("run_id", F.lit("/")), F.array().cast("array<string>")
    held = {"base": base, "crawl_complete": F.lit(True), "scope_narrowed": F.lit(False), "entry_url": base, "expected_locales": F.array(F.lit("en"), F.lit("de")), "include_paths": none, "exclude_paths": none, "requested": none}
    held |= {"external_complete": F.lit(False), "weights_complete": F.lit(False), "render_complete": F.lit(True), "sitemap_source": F.lit(None).cast("string"), "sitemap_discovery": F.lit(None).cast("string"), "now": F.lit(None).cast("timestamp")}
    run = stored(fetched.select("run_id").distinct()).select("run_id", *[c.alias(name) for name, c in held.items()])
    return rules.detect(rules.Crawl(spark, crawled(fetched), run))


def _one_of_each_address(pages: DataFrame) -> DataFrame:
    """(run_id, url, page_id, html): the origin is the run; of rows with one address the smallest page_id stays."""
    url = page_url(F.col("url"))
    row = F.struct("page_id", "html")
    one = pages.select(url.alias("url"), "page_id", "html").where("url is not null").groupBy(origin_of(F.col("url")).alias("run_id"), "url").agg(F.min(row).alias("row"))
    return one.select("run_id", "url", "row.page_id", "row.html")


# ---------------------------------------------------------------- runs, on events


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, event_type || ':' || user_id AS identity, event_id FROM events),
    days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM f)),
    n AS (SELECT *, row_number() OVER (PARTITION BY day, identity ORDER BY event_id) AS nth FROM f),
    cur AS (SELECT n.* FROM n JOIN days USING (day) WHERE before IS NOT NULL),
    old AS (SELECT days.day, n.identity, n.nth FROM n JOIN days ON n.day = days.before)
    SELECT coalesce(cur.day, old.day) AS day, CASE WHEN old.day IS NULL THEN 'new' WHEN cur.day IS NULL THEN 'resolved' ELSE 'still_present' END AS status, count(*) AS n
    FROM cur FULL JOIN old ON cur.day = old.day AND cur.identity = old.identity AND cur.nth = old.nth GROUP BY ALL""")
def run_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.concat_ws(":", "event_type", "user_id").alias("identity"), F.col("event_id").alias("id"))
    days = rows.select("day").distinct().withColumn("before", F.lag("day").over(Window.orderBy("day"))).where("before is not null")
    old = rows.withColumnRenamed("day", "before").join(days, "before")
    return runs.compare(old, rows.join(days, "day"), ["day"]).groupBy("day", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS types, max(value) > 1 AS whole FROM events GROUP BY ALL),
    p AS (SELECT *, lag(types) OVER w AS before, lag(whole) OVER w AS before_whole FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, CASE WHEN before IS NULL THEN 'no_predecessor' WHEN NOT whole OR NOT before_whole THEN 'incomplete_crawl' WHEN types <> before THEN 'rules_changed' ELSE 'comparable' END AS reason, count(*) AS n FROM p GROUP BY ALL""")
def run_comparability(spark, sf_dir):
    none = F.array().cast("array<string>")
    scope = F.struct(none.alias("include_paths"), none.alias("exclude_paths"), none.alias("locales"))
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("rule_set"), (F.max("value") > 1).alias("crawl_complete"))
    rows = rows.select(F.col("user_id").alias("project_id"), F.col("day").cast("string").alias("run_id"), F.col("day").alias("created_at"), "crawl_complete", scope.alias("scope"), "rule_set")
    return runs.with_predecessor(rows).groupBy(F.col("project_id").alias("user_id"), F.coalesce("reason", F.lit("comparable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS types FROM events GROUP BY ALL),
    last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 12),
    kinds AS (SELECT DISTINCT user_id, unnest(types) AS type FROM last),
    n AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS type, count(*) AS n FROM events GROUP BY ALL),
    grid AS (SELECT k.user_id, k.type, l.day, CASE WHEN list_contains(l.types, k.type) THEN coalesce(n.n, 0) END AS cell FROM kinds k JOIN last l USING (user_id) LEFT JOIN n ON n.user_id = k.user_id AND n.day = l.day AND n.type = k.type)
    SELECT user_id, type, string_agg(coalesce(CAST(cell AS VARCHAR), '-'), ' ' ORDER BY day) AS cells, CAST(sum(cell) AS BIGINT) AS found, coalesce(min(cell) <> max(cell), false) AS moved FROM grid GROUP BY user_id, type""")
def trend_grid(spark, sf_dir):
    none = F.array().cast("array<string>")
    events = table(spark, sf_dir, "events").withColumn("run_id", F.concat_ws("/", "user_id", F.to_date("ts").cast("string")))
    rows = events.groupBy("run_id", F.col("user_id").alias("project_id"), F.to_date("ts").alias("created_at")).agg(F.collect_set("event_type").alias("rule_set"))
    rows = rows.withColumns({"crawl_complete": F.lit(True), "scope": F.struct(none.alias("include_paths"), none.alias("exclude_paths"), none.alias("locales"))})
    out = runs.trend(rows, events.select("run_id", F.col("event_type").alias("type")))
    return out.select(F.col("project_id").alias("user_id"), "type", joined(F.transform("cells", lambda c: F.coalesce(c.cast("string"), F.lit("-"))), " ").alias("cells"), "found", "moved")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth, o_orderpriority LIKE '1%' AS base FROM orders)
    SELECT o_custkey, o_orderkey FROM o WHERE NOT base AND nth > 3""")
def retention_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.startswith("o_orderpriority", F.lit("1")).alias("is_baseline"))
    return runs.runs_to_expire(rows).select(F.col("project_id").alias("o_custkey"), F.col("run_id").alias("o_orderkey"))




@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM n WHERE value < 60)
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS length FROM f GROUP BY user_id, i HAVING count(*) >= {FAILURE_BURST}""")
def failure_burst(spark, sf_dir):
    return bursts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 60, FAILURE_BURST)


@query(f"""WITH n AS (SELECT user_id, ts, count(*) OVER w AS seen, sum(CAST(value < 60 AS BIGINT)) OVER w AS failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, ts AS at, seen, CAST(failures AS BIGINT) AS failures FROM n WHERE seen >= {FAILURE_SAMPLE} AND failures >= seen * {FAILURE_RATE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen) = 1""")
def failure_rate(spark, sf_dir):
    return stopped_by_rate(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 60, FAILURE_RATE, FAILURE_SAMPLE)


@query("""SELECT band, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN v IS NULL THEN 'unmeasured' WHEN v <= 800 THEN 'good' WHEN v <= 1800 THEN 'needs_improvement' ELSE 'poor' END AS band
    FROM (SELECT event_type, CASE WHEN event_type <> 'login' THEN value * 10 END AS v FROM events)) GROUP BY ALL""")
def band_values(spark, sf_dir):
    value = F.when(F.col("event_type") != "login", F.col("value") * 10)
    return table(spark, sf_dir, "events").groupBy(bands.band("ttfb", value).alias("band"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label, coverage, count(*) AS n FROM (SELECT
    CASE WHEN o_orderstatus = 'F' AND lim THEN 'Stopped at page limit' WHEN o_orderstatus = 'F' AND NOT whole THEN 'Partial' WHEN o_orderstatus = 'F' THEN 'Done' ELSE 'Running' END AS label,
    CASE WHEN lim THEN 'page_limit' WHEN NOT whole THEN 'stopped_early' WHEN whole THEN 'whole_crawl' ELSE 'not_recorded' END AS coverage
    FROM (SELECT o_orderstatus, o_totalprice > 400000 AS lim, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority NOT LIKE '2%' END AS whole FROM orders)) GROUP BY ALL""")
def coverage_case(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), (F.col("o_totalprice") > 400000).alias("lim"),
        F.when(~F.startswith("o_orderpriority", F.lit("5")), ~F.startswith("o_orderpriority", F.lit("2"))).alias("whole"),
    )
    label = bands.run_status_label(F.col("status"), F.col("whole"), F.col("lim"))
    return rows.groupBy(label.alias("label"), bands.crawl_coverage(F.col("whole"), F.col("lim")).alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_detail(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- relational operators, on the star schema


@query("""SELECT nations, count(*) AS n, min(l_orderkey) AS first FROM (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS nations
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) GROUP BY nations HAVING count(*) >= 2""")
def correlate_sets(spark, sf_dir):
    """Orders whose lines come from the same set of nations."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    sets = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_nationkey")).alias("nations"))
    return sets.groupBy("nations").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first")).where("n >= 2").withColumn("nations", joined(F.col("nations"), ","))


@query("""WITH n AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC, c_custkey) AS depth FROM n),
    p AS (SELECT *, row_number() OVER (ORDER BY depth, c_mktsegment) AS place FROM d) SELECT c_custkey, c_mktsegment, orders, CAST(place AS INTEGER) AS place FROM p WHERE place <= 12""")
def round_robin_sample(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"))
    depth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("orders"), "c_custkey"))
    # no segment gives more than twelve, so few rows are left for the last order
    few = rows.withColumn("depth", depth).where("depth <= 12").orderBy("depth", "c_mktsegment").limit(12)
    return few.withColumn("place", F.row_number().over(Window.orderBy("depth", "c_mktsegment"))).drop("depth")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def predecessor(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), days.alias("days"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, sf_dir):
    newest = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest.alias("o")).select("o_custkey", "o.*")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_absent(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""SELECT CASE WHEN url NOT LIKE 'https%' THEN 'unusable' WHEN url NOT LIKE '%.example.com/%' THEN 'cross_origin' WHEN regexp_matches(url, '^https?://[^/]+/(de|fr)/') THEN 'out_of_scope' ELSE 'comparable' END AS part,
    count(*) AS n FROM pages GROUP BY 1""")
def reconcile(spark, sf_dir):
    url = F.col("url")
    part = (
        F.when(~F.startswith(url, F.lit("https")), "unusable").when(~F.contains(url, F.lit(".example.com/")), "cross_origin")
        .when(url.rlike("^https?://[^/]+/(de|fr)/"), "out_of_scope").otherwise("comparable")
    )
    return table(spark, sf_dir, "pages").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


#: Patterns in the role of robots rules: (kind, pattern).
_PATTERNS = [("disallow", "/"), ("allow", "/*A"), ("disallow", "/*E$"), ("allow", "/S"), ("disallow", "/STANDARD*N"), ("allow", "/*D*E")]


def _pattern_rows() -> str:
    def regex(p: str) -> str:
        return "^" + p.rstrip("$").replace("*", ".*") + ("$" if p.endswith("$") else "")

    return ", ".join(f"({i}, '{k}', '{p}', '{regex(p)}')" for i, (k, p) in enumerate(_PATTERNS))


@query(f"""WITH rules(ix, kind, pattern, re) AS (VALUES {_pattern_rows()}), paths AS (SELECT DISTINCT '/' || p_type AS path FROM part),
    best AS (SELECT path, kind, pattern FROM paths JOIN rules ON regexp_matches(path, re) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(pattern) DESC, kind = 'allow' DESC, ix) = 1)
    SELECT path, coalesce(kind = 'allow', true) AS allowed, pattern FROM paths LEFT JOIN best USING (path)""")
def theta_prefix(spark, sf_dir):
    """The longest pattern decides, allowing wins ties."""
    rows = [("r", "*", i, kind, pattern, pattern, i, True) for i, (kind, pattern) in enumerate(_PATTERNS)]
    rule = spark.createDataFrame(rows, "run_id string, agent string, rule_ix int, kind string, pattern string, line string, line_number int, evaluable boolean")
    paths = table(spark, sf_dir, "part").select(F.lit("r").alias("run_id"), F.concat(F.lit("/"), "p_type").alias("path")).distinct()
    return verdicts(rule, paths).select("path", "allowed", "rule.pattern")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS total FROM part)
    SELECT p_brand, p_partkey, p_retailprice, CAST(place AS INTEGER) AS place, greatest(total - 5, 0) AS hidden FROM r WHERE place <= 5""")
def topk_hidden(spark, sf_dir):
    return reports.with_hidden(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5)


@query("""SELECT n_name, r_name, count(*) AS lines, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY n_name, r_name""")
def inner_join_agg(spark, sf_dir):
    """Returned revenue by nation; the small dimensions broadcast by their size."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2")
def having_dupes(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def count_distinct_pages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT o_orderkey, CASE WHEN again THEN 'O' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, true AS again FROM lineitem WHERE l_linestatus = 'O') ON l_orderkey = o_orderkey""")
def update_from(spark, sf_dir):
    """A later observation replaces the first."""
    again = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("again", F.lit(True))
    return table(spark, sf_dir, "orders").join(again, "o_orderkey", "left").select("o_orderkey", F.when(F.col("again"), "O").otherwise(F.col("o_orderstatus")).alias("status"))
