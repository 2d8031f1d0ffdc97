"""Reports over orders, line items, parts and events in the roles of runs, findings, families and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingoscope.functions import sentences
from lingoscope.operators.storage import parts_for
from lingoscope.plans import client_report, reports, runs
from lingoscope.plans.catalogue import joined, query, table
from lingoscope.schema import RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _these(n: str, one: str, many: str) -> str:
    return f"CASE WHEN {n} IS NULL THEN '{many}' WHEN {n} = 1 THEN '1 {one}' ELSE {n} || ' {many}' END"


#: Counts of the details below, as SQL over p: lists of 0 to 3, numbers of 0 to 2 or none.
_LIST, _SIZE, _NUMBER = "nullif(p // 30 % 4, 0)", "CASE WHEN p % 7 > 0 THEN p // 30 % 4 END", "CASE WHEN p % 5 > 0 THEN p // 30 % 3 END"


def _sentence_sql() -> str:
    cases = []
    for kind in RULES:
        text = _quoted(sentences.CLIENT_SENTENCES[kind])
        if kind in sentences.CLIENT_COUNTED:
            field, one, many = sentences.CLIENT_COUNTED[kind]
            n = _NUMBER if field in ("count", "daysRemaining") else _SIZE if field in ("entries", "hops") else _LIST
            words = _these(n, one, many)
            if kind == "image_legacy_format":
                words = f"CASE WHEN p % 5 > 0 AND p % 11 > 0 THEN ({_NUMBER}) || ' of ' || (p % 11) || ' images' ELSE {words} END"
            if kind == "certificate_problem":
                text = f"CASE WHEN ({n}) > 0 THEN {_quoted(sentences.CLIENT_SENTENCES[kind + '/expires'])} ELSE {text} END"
            text = f"replace({text}, '{{these}}', {words})"
            if kind in sentences.CLIENT_AGREES:
                one, many = sentences.CLIENT_AGREES[kind]
                text = f"replace({text}, '{{agree}}', CASE WHEN ({n}) = 1 THEN '{one}' ELSE '{many}' END)"
        if kind == "content_untranslated":
            text = f"CASE WHEN p % 2 = 0 THEN {_quoted(sentences.CLIENT_SENTENCES[kind + '/placeholder_markers'])} ELSE {text} END"
        if kind == "redirect_chain":
            text = f"CASE WHEN p % 2 = 1 THEN {_quoted(sentences.CLIENT_SENTENCES[kind + '/loop'])} ELSE {text} END"
        text = f"replace({text}, '{{language}}', CASE WHEN p % 4 = 0 THEN 'another language' ELSE 'l' || p END)"
        text = f"replace({text}, '{{fields}}', CASE p // 30 % 4 WHEN 0 THEN 'wording' WHEN 1 THEN 'f1' WHEN 2 THEN 'f1 or f2' ELSE 'f1 or f2 or f3' END)"
        text = f"replace({text}, '{{share}}', CASE WHEN p % 9 = 0 THEN '' ELSE ' About ' || greatest(1, CAST(floor(p % 1000 / 1000.0 * 100 + 0.5) AS BIGINT)) || '% of it looks different.' END)"
        cases.append(f"WHEN '{kind}' THEN {text}")
    return f"CASE kind {' '.join(cases)} ELSE {_quoted(sentences.CLIENT_UNKNOWN)} END"


_KIND = "list_extract([" + ", ".join(f"'{name}'" for name in RULES) + "], CAST(p_partkey % 30 AS INTEGER) + 1)"


@query(f"WITH f AS (SELECT p_partkey AS p, {_KIND} AS kind FROM part) SELECT p, {_sentence_sql()} AS sentence FROM f")
def client_sentences(spark, sf_dir):
    """What a finding of each kind, with more or less in its detail, is to those whose site it is."""
    p = F.col("p_partkey")
    some = lambda test, value: F.when(test, value)
    size = (F.floor(p / 30) % 4).cast("int")
    items = lambda head: F.slice(F.array(*(F.lit(f"{head}{i}") for i in (1, 2, 3))), F.lit(1), size)
    number = some(p % 5 > 0, F.floor(p / 30) % 3)
    language = F.when(p % 4 > 0, F.concat(F.lit("l"), p.cast("string"))).when(p % 8 == 0, "")
    things = some(p % 7 > 0, F.transform(items("e"), lambda x: F.struct(x.alias("url"), F.lit(404).alias("status"))))
    detail = F.struct(
        F.when(p % 2 == 0, "placeholder_markers").otherwise("loop").alias("kind"), language.alias("locale"), language.alias("missingLocale"), *(items("f").alias(n) for n in ("presentLocales", "fields", "urls", "linkedFrom")),
        things.alias("entries"), things.alias("hops"), number.alias("daysRemaining"), number.alias("count"), some(p % 11 > 0, p % 11).alias("of"), (p % 1000).alias("changedPixels"), F.when(p % 9 == 0, 0).otherwise(1000).alias("comparedPixels"),
    )
    kind = F.get(F.array(*map(F.lit, RULES)), (p % 30).cast("int"))
    return table(spark, sf_dir, "part").select(p.alias("p"), sentences.client_sentence(kind, F.to_json(detail)).alias("sentence"))


_S = sentences
_REPORT = f"""WITH r AS (SELECT o_orderkey AS run, o_custkey, o_orderdate, o_orderkey % 2 = 0 AS whole, o_orderkey % 5 AS base FROM orders WHERE o_orderstatus <> 'O'),
    l AS (SELECT DISTINCT l_orderkey AS run, l_linenumber * 1000000 + l_partkey AS ord, l_partkey AS p, l_returnflag = 'R' AS gone FROM lineitem JOIN r ON r.run = l_orderkey),
    typed AS (SELECT *, CASE p % 4 WHEN 0 THEN 'link_broken' WHEN 1 THEN 'canonical_missing' WHEN 2 THEN 'noindex_present' ELSE 'of_the_future' END AS type, CASE WHEN p % 100 = 0 THEN 260 ELSE p % 7 END AS k FROM l),
    kinds AS (SELECT run, gone, type, count(*) AS n, row_number() OVER (PARTITION BY run, gone ORDER BY min(ord), type) AS place,
        CASE type WHEN 'link_broken' THEN '{_S.CLIENT_LABELS["link_broken"]}' WHEN 'canonical_missing' THEN '{_S.CLIENT_LABELS["canonical_missing"]}' WHEN 'noindex_present' THEN '{_S.CLIENT_LABELS["noindex_present"]}' ELSE '{_S.CLIENT_UNKNOWN_LABEL}' END AS heading FROM typed GROUP BY run, gone, type),
    pic AS (SELECT run, '/s' || p AS url, row_number() OVER (PARTITION BY run ORDER BY p % 50 DESC, '/s' || p) AS nth FROM (SELECT DISTINCT run, p FROM l WHERE p % 8 = 3 AND p % 3 > 0 AND p % 50 > 0))
    SELECT run, 0 AS part, 0::BIGINT AS place, 0::BIGINT AS nth, 'Customer ' || o_custkey AS heading, 'Checked ' || strftime(o_orderdate, '%-d %B %Y') || ' · ' || (o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' page' ELSE ' pages' END || ' looked at' AS line, 'https://c.example/' || o_custkey AS note, NULL AS pages FROM r
    UNION ALL SELECT run, 1, 0, 0, NULL, CASE WHEN whole THEN '{_S.CLIENT_CRAWL["whole_crawl"]}' ELSE '{_S.CLIENT_CRAWL["page_limit"]}' END, NULL, NULL FROM r
    UNION ALL SELECT run, 1, 1, 0, NULL, CASE base WHEN 0 THEN '{_S.CLIENT_PICTURES["no_baseline"]}' ELSE 'Appearance was compared on 4 of ' || (o_custkey % 3) || ' pages against a reference set earlier.' END, NULL, NULL FROM r
    UNION ALL SELECT run, 2, place, ord, heading, CASE type WHEN 'link_broken' THEN CASE k WHEN 0 THEN 'pages link' WHEN 1 THEN '1 page links' ELSE k || ' pages link' END || ' to a page on this site that does not open, so visitors following it reach an error.'
        WHEN 'canonical_missing' THEN '{_S.CLIENT_SENTENCES["canonical_missing"]}' WHEN 'noindex_present' THEN '{_S.CLIENT_SENTENCES["noindex_present"]}' ELSE '{_S.CLIENT_UNKNOWN}' END,
        CASE WHEN type = 'link_broken' AND k = 260 THEN '261{client_report.WITHHELD}' ELSE n || CASE WHEN n = 1 THEN ' instance' ELSE ' instances' END END,
        CASE WHEN type <> 'link_broken' THEN '/u' || p WHEN k < 260 THEN array_to_string(list_concat(list_transform(range(1, k + 1), lambda i: '/l' || i), ['/t' || p]), '|') END
        FROM (SELECT * FROM typed WHERE NOT gone) JOIN (SELECT run, type, n, place, heading FROM kinds WHERE NOT gone) USING (run, type)
    UNION ALL SELECT run, 2, 0, 0, NULL, '{client_report.NOTHING_FOUND}', NULL, NULL FROM r WHERE run NOT IN (SELECT run FROM l WHERE NOT gone)
    UNION ALL SELECT pic.run, 3, nth, 0, NULL, url, CASE WHEN base = 1 THEN '{client_report.COMPARED}' ELSE '{client_report.SUPERSEDED}' END, NULL FROM pic JOIN r ON r.run = pic.run
    UNION ALL SELECT run, 4, place, 0, NULL, heading, CASE WHEN n > 1 THEN n || ' instances' END, NULL FROM kinds WHERE gone"""


def _told(name: str, p):
    return F.concat(F.lit(name), p.cast("string"))


@query(_REPORT)
def client_reports(spark, sf_dir):
    """The document of every ended run: orders are runs, their line items findings, those returned are gone since the run before."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")
    base = key % 5
    summary = F.struct(F.lit(True).alias("complete"), F.when(base != 0, "b1").alias("baseline_run_id"), F.lit(6).alias("watched"), F.lit(4).alias("compared"))
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = parts_for(orders, lineitem)
    ran = orders.select(
        key.alias("run_id"), _told("Customer ", who).alias("name"), _told("https://c.example/", who).alias("start_url"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"), (who % 3).alias("pages_crawled"), F.lit(True).alias("crawl_complete"), (key % 2 != 0).alias("page_limit"),
        F.struct(none.alias("include_paths"), none.alias("exclude_paths")).alias("scope"), none.alias("rule_set"), summary.alias("visual_summary"), F.when(base == 1, "b1").otherwise("b2").alias("project_baseline"),
    ).repartition(parts, "run_id")
    p = F.col("p")
    items = lineitem.select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("p"), (F.col("l_returnflag") == "R").alias("gone"))
    items = items.repartition(parts, "run_id").distinct()
    links = F.when(p % 100 == 0, 260).otherwise(p % 7)
    linked = F.transform(F.filter(F.sequence(F.lit(0), links), lambda i: i > 0), lambda i: F.concat(F.lit("/l"), i.cast("string")))
    kind = F.when(p % 4 == 0, "link_broken").when(p % 4 == 1, "canonical_missing").when(p % 4 == 2, "noindex_present").otherwise("of_the_future")
    url = _told("/u", p)
    detail = F.when(p % 4 == 0, F.to_json(F.struct(_told("/t", p).alias("target"), linked.alias("linkedFrom")))).otherwise(F.to_json(F.struct(url.alias("url"))))
    typed = items.select("run_id", "ord", "gone", kind.alias("type"), F.when(p % 4 != 0, url).alias("url"), detail.alias("detail"))
    compared = typed.select("run_id", "ord", "type", F.when(F.col("gone"), "resolved").otherwise("new").alias("status"))
    shots = items.where("p % 8 = 3").select("run_id", "p").distinct().select(
        "run_id", _told("/s", p).alias("url"), F.lit(None).cast("string").alias("capture_error"), F.when(p % 3 == 0, F.lit("2026-01-01").cast("timestamp")).alias("expired_at"), F.lit(True).alias("comparable"),
        F.lit(None).cast("string").alias("reason"), (p % 50 * 1000).alias("changed_pixels"), F.lit(1000000).alias("compared_pixels"),
    )
    out = client_report.lines(ran, typed.where("not gone").drop("gone"), compared, shots, parts)
    return out.withColumn("pages", joined(F.col("pages"))).withColumnRenamed("run_id", "run")


@query("""WITH pg AS (SELECT p_partkey AS p, CAST(p_partkey // 2 AS BIGINT) AS f FROM part WHERE p_partkey % 6 <> 1),
    fam AS (SELECT f % 11 AS run, list_extract(['a', 'A', 'é', '_', 'Z', 'z-', 'z/'], CAST(f % 7 AS INTEGER) + 1) || f AS key, count(*) AS n,
        CASE WHEN bool_or(p % 2 = 0) THEN CASE WHEN f * 2 % 5 = 0 THEN 'broken' ELSE 'present' END ELSE 'missing' END AS en, CASE WHEN bool_or(p % 2 = 1) THEN CASE WHEN (f * 2 + 1) % 5 = 0 THEN 'broken' ELSE 'present' END ELSE 'missing' END AS de FROM pg GROUP BY f),
    total AS (SELECT run, count(*) FILTER (n > 1) AS families, count(*) FILTER (n > 1 AND en = 'present' AND de = 'present') AS clean, count(*) FILTER (n = 1) AS singles FROM fam GROUP BY run)
    SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY en = 'present' AND de = 'present', key COLLATE en, key) AS INTEGER) AS place, key, en || '|' || de AS cells, greatest(families - 14, 0) AS hidden, clean, singles
    FROM fam JOIN total USING (run) WHERE n > 1 QUALIFY place <= 14""")
def parity_by_name(spark, sf_dir):
    """Families of parts, those with a problem first, then by name as people sort them."""
    p, f = F.col("p"), F.col("f")
    pages = table(spark, sf_dir, "part").where("p_partkey % 6 <> 1").select(F.col("p_partkey").alias("p"), F.floor(F.col("p_partkey") / 2).alias("f"))
    name = F.get(F.array(*map(F.lit, ("a", "A", "é", "_", "Z", "z-", "z/"))), (f % 7).cast("int"))
    pages = pages.select(
        (f % 11).alias("run_id"), _told("/", p).alias("url"), F.when(p % 2 == 0, "en").otherwise("de").alias("locale"), F.concat(name, f.cast("string")).alias("group_key"),
        F.when(p % 5 == 0, 404).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("fetch_error"),
    )
    ran = pages.select("run_id").distinct().withColumn("expected_locales", F.array(F.lit("en"), F.lit("de")))
    out = reports.parity_listed(pages, ran)
    return out.select(F.col("run_id").alias("run"), "place", F.col("group_key").alias("key"), joined(F.col("cells")).alias("cells"), "hidden", "clean", "singles")


@query("""SELECT user_id AS run, event_id AS page, '/e' || event_id AS url, event_id % 900 AS byte_size, CASE WHEN user_id % 3 > 0 THEN 'b' || (user_id % 3) END AS compared_with,
    CASE WHEN user_id % 30 < 25 AND user_id % 30 % 4 > 0 THEN 'b' || (user_id % 30 % 4) END AS project_baseline, CASE WHEN user_id % 30 < 25 AND user_id % 30 % 2 = 0 THEN '#a|.b' ELSE '' END AS masks, user_id % 1000 AS pages_crawled
    FROM events WHERE event_id % 6 = 0""")
def snapshots_of_runs(spark, sf_dir):
    """Events as pages and pictures, users as runs, nations as their projects."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    run, page = F.col("user_id").alias("run_id"), F.col("event_id").alias("page_id")
    user, n = F.col("user_id"), F.col("n_nationkey")
    pages = events.where("event_id % 2 = 0").select(run, page, _told("/e", F.col("event_id")).alias("url"))
    shots = events.where("event_id % 3 = 0").select(run, page, (F.col("event_id") % 900).alias("byte_size"), F.lit(b"png").alias("picture"))
    summary = F.struct(F.when(user % 3 > 0, _told("b", user % 3)).alias("baseline_run_id"))
    ran = events.select("user_id").distinct().select(run, (user % 30).alias("project_id"), summary.alias("visual_summary"), (user % 1000).alias("pages_crawled"))
    projects = table(spark, sf_dir, "nation").select(n.cast("long").alias("project_id"), F.when(n % 4 > 0, _told("b", n % 4)).alias("baseline_run_id"), F.when(n % 2 == 0, F.array(F.lit("#a"), F.lit(".b"))).alias("mask_selectors"))
    out = runs.recorded_snapshots(shots, pages, ran, projects)
    return out.select(
        F.col("run_id").alias("run"), F.col("page_id").alias("page"), "url", "byte_size", F.col("visual_summary.baseline_run_id").alias("compared_with"), "project_baseline",
        F.coalesce(joined(F.col("mask_selectors")), F.lit("")).alias("masks"), "pages_crawled",
    )
