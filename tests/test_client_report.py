"""The client's document, sentences of single findings, orders by collation, listings of a run."""

import json
import re

from pyspark.sql import functions as F

from lingoscope.functions import sentences
from lingoscope.functions.collation import collated
from lingoscope.plans import client_report, reports, runs
from lingoscope.schema import MAX_LISTED_PAGES, MAX_UNBROKEN_PAGES, RULES

RUNS = (
    "run_id string, name string, start_url string, status string, created_at timestamp, started_at timestamp, pages_crawled long, crawl_complete boolean, page_limit boolean, "
    "scope struct<include_paths:array<string>,exclude_paths:array<string>>, rule_set array<string>, visual_summary struct<complete:boolean,baseline_run_id:string,watched:int,compared:int>, project_baseline string"
)
FINDINGS = "run_id string, ord long, type string, url string, detail string"
COMPARED = "run_id string, ord long, type string, status string"
SHOTS = "run_id string, url string, capture_error string, expired_at timestamp, comparable boolean, reason string, changed_pixels long, compared_pixels long"


def said(spark, rows):
    df = spark.createDataFrame([(i, kind, None if d is None else json.dumps(d)) for i, (kind, d) in enumerate(rows)], "i int, kind string, detail string")
    return [r["s"] for r in df.select("i", sentences.client_sentence(F.col("kind"), F.col("detail")).alias("s")).orderBy("i").collect()]


def test_every_rule_has_a_sentence():
    assert set(RULES) == {name.split("/")[0] for name in sentences.CLIENT_SENTENCES}
    assert set(sentences.CLIENT_COUNTED) | set(sentences.CLIENT_AGREES) <= set(RULES)


def test_sentences_count_what_is_known_and_leave_the_rest_open(spark):
    got = said(spark, [
        ("missing_locale", {"presentLocales": ["en"], "missingLocale": "de"}), ("missing_locale", {"presentLocales": []}), ("hreflang_target_failed", {"locale": ""}),
        ("link_broken", {"linkedFrom": ["/a"]}), ("link_broken", {"linkedFrom": []}), ("sitemap_url_failed", {"entries": [{"raw": "x"}]}), ("sitemap_url_failed", {"entries": []}), ("sitemap_url_failed", {}),
        ("robots_blocks_indexable", {"urls": ["/a"]}), ("robots_blocks_indexable", {"urls": ["/a", "/b"]}), ("certificate_problem", {"daysRemaining": 1}), ("certificate_problem", {"daysRemaining": 0}),
        ("redirect_chain", {"kind": "loop"}), ("redirect_chain", {"kind": "chain", "hops": [{"url": "a"}, {"url": "b"}]}), ("image_legacy_format", {"count": 1, "of": 3}), ("image_legacy_format", {"count": 2}),
        ("visual_changed", {"changedPixels": 1, "comparedPixels": 100000}), ("visual_changed", {"changedPixels": 125, "comparedPixels": 1000}), ("visual_changed", {"changedPixels": 5}), ("metadata_missing", {"fields": ["title", "description"]}),
        ("content_untranslated", {"kind": "placeholder_markers"}), ("not_yet_known", {"url": "/a"}), (None, {}), ("noindex_present", None), ("link_broken", {"linkedFrom": "broken"}),
    ])
    assert got[0] == "This page is published in 1 language but not in de, so visitors reading that language reach nothing."
    assert got[1] == "This page is published in languages but not in another language, so visitors reading that language reach nothing."
    assert got[2] == "This page points visitors to its another language version, but that version does not open."
    assert got[3].startswith("1 page links to a page on this site") and got[4].startswith("pages link to a page") and got[24] == got[4]
    assert "includes 1 address that does not open" in got[5] and "includes 0 addresses that do not open" in got[6] and "includes addresses that do not open" in got[7]
    assert "ignore 1 page and submits that same page" in got[8] and "ignore 2 pages and submits those same pages" in got[9]
    assert "expires in 1 day." in got[10] and got[11].startswith("There is a problem")
    assert got[12].startswith("This address sends visitors round") and "through 2 steps before" in got[13]
    assert got[14].startswith("1 of 3 images on this page uses older") and got[15].startswith("2 images on this page use older")
    assert got[16].endswith("taken. About 1% of it looks different.") and got[17].endswith(" About 13% of it looks different.") and got[18].endswith("was taken.")
    assert "no title or description, so" in got[19] and got[20].startswith("This page still shows placeholder")
    assert got[21] == got[22] == sentences.CLIENT_UNKNOWN and got[23] == sentences.CLIENT_SENTENCES["noindex_present"]


def run(name, status="done", pages=2, summary=(True, "b1", 3, 2), base="b1"):
    return (name, "Shop", "https://shop.example/", status, None, None, pages, True, False, ([], []), ["link_broken"], summary, base)


def test_work_on_a_document_is_in_parts_of_so_many_rows(spark, monkeypatch):
    """No grouping, join or window is in the session's number of tasks, which doesn't grow with the tables."""
    n = 3000
    key = F.col("id").cast("string").alias("run_id")
    ran = spark.createDataFrame([run("a")], RUNS).drop("run_id").crossJoin(spark.range(n).select(key))
    found = spark.range(n).select(key, F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "link_broken").otherwise("noindex_present").alias("type"), F.lit("/u").alias("url"), F.lit(None).cast("string").alias("detail"))
    compared = found.select("run_id", "ord", "type", F.lit("resolved").alias("status"))
    shots = spark.createDataFrame([], SHOTS)
    monkeypatch.setattr(client_report, "parts_for", lambda *tables: 1 + sum(t.count() for t in tables) // 1000, raising=False)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = client_report.lines(ran, found, compared, shots)
        plan = out._jdf.queryExecution().executedPlan().toString()
        counts = set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan))
        assert counts == {str(1 + 3 * n // 1000)}
        assert out.count() == n * 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_the_document(spark):
    day = F.lit("2026-09-08 10:00:00").cast("timestamp")
    ran = spark.createDataFrame([run("a", pages=1), run("b", base="b2"), run("going", status="running"), run("waiting", status="queued")], RUNS).withColumn("created_at", day)
    long = lambda n: json.dumps({"target": "/t", "linkedFrom": [f"/{i}" for i in range(n)]})
    found = [
        ("a", 1, "link_broken", None, long(MAX_LISTED_PAGES - 1)), ("a", 2, "noindex_present", "/x", '{"url":"/x"}'), ("a", 3, "link_broken", None, long(MAX_LISTED_PAGES)),
        ("a", 4, "link_broken", None, long(MAX_UNBROKEN_PAGES - 1)), ("going", 1, "link_broken", None, long(1)),
    ]
    compared = [("a", 1, "link_broken", "new"), ("a", 7, "new_rule", "resolved"), ("b", 1, "link_broken", "resolved"), ("b", 2, "link_broken", "resolved"), ("waiting", 1, "link_broken", "resolved")]
    shots = [("b", "/B", None, None, True, None, 500, 1000), ("b", "/a", None, None, True, None, 500, 1000), ("b", "/most", None, None, True, None, 600, 1000), ("b", "/same", None, None, True, None, 0, 1000), ("b", "/no", "crash", None, None, None, None, None)]
    shots = spark.createDataFrame(shots, SHOTS).unionByName(spark.createDataFrame([("b", "/old", None, None, True, None, 900, 1000)], SHOTS).withColumn("expired_at", day))
    rows = client_report.lines(ran, spark.createDataFrame(found, FINDINGS), spark.createDataFrame(compared, COMPARED), shots).orderBy("run_id", "part", "place", "nth").collect()
    assert {r["run_id"] for r in rows} == {"a", "b"}
    part = lambda run_id, at: [r for r in rows if (r["run_id"], r["part"]) == (run_id, at)]
    assert [(r["heading"], r["line"], r["note"]) for r in part("a", client_report.HEAD)] == [("Shop", "Checked 8 September 2026 · 1 page looked at", "https://shop.example/")]
    assert [r["line"] for r in part("a", client_report.COVERED)] == ["This check looked at every page it could reach on the site.", "Appearance was compared on 2 of 1 pages against a reference set earlier."]
    listed = part("a", client_report.FOUND)
    assert [(r["place"], r["nth"], r["note"], None if r["pages"] is None else len(r["pages"])) for r in listed] == [
        (1, 1, "3 instances", 250), (1, 3, "251 pages are affected — too many to list in a printed report. Your developer can see the full list in the check itself.", None), (1, 4, "3 instances", 20), (2, 2, "1 instance", 1)
    ]
    assert [r["line"] for r in part("b", client_report.FOUND)] == [client_report.NOTHING_FOUND]
    assert [(r["line"], r["note"]) for r in part("b", client_report.DIFFERENT)] == [(u, client_report.SUPERSEDED) for u in ("/most", "/a", "/B")] and not part("a", client_report.DIFFERENT)
    assert [(r["line"], r["note"]) for r in part("a", client_report.GONE)] == [("Something to look at", None)]
    assert [(r["line"], r["note"]) for r in part("b", client_report.GONE)] == [("Links to one of your pages that does not open", "2 instances")]
    sheets = client_report.found(spark.createDataFrame(found, FINDINGS).where("run_id = 'a'")).orderBy("ord").collect()
    assert [r["unbroken"] for r in sheets] == [False, True, False, True]


def test_empty_tables_give_an_empty_document(spark):
    empty = [spark.createDataFrame([], s) for s in (RUNS, FINDINGS, COMPARED, SHOTS)]
    assert client_report.lines(*empty).collect() == []


def test_names_go_by_collation_then_code(spark):
    names = ["b", "B", "a/1", "A", "é", "a", "a-1", "_", "e", "f", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in df.orderBy(*collated("name")).collect()] == [None, "_", "a", "A", "a-1", "a/1", "b", "B", "e", "é", "f"]


def test_clean_families_fill_the_grid_after_those_with_problems(spark):
    rows = [("r", f"/{k}{l}", l, k, 404 if (k, l) == ("z", "de") else 200, None) for k in "bAz" for l in ("en", "de")] + [("r", "/one", "en", "one", 200, None), ("r", "/two", "de", "two", 200, None)]
    pages = spark.createDataFrame(rows, "run_id string, url string, locale string, group_key string, http_status int, fetch_error string")
    run = spark.createDataFrame([("r", ["en", "de"])], "run_id string, expected_locales array<string>")
    got = [tuple(r) for r in reports.parity_listed(pages, run, 2).orderBy("place").collect()]
    assert got == [("r", 1, "z", ["present", "broken"], 1, 2, 2), ("r", 2, "A", ["present", "present"], 1, 2, 2)]


def test_listings_of_a_run(spark):
    pages = spark.createDataFrame([("r", 1, "/b"), ("r", 2, "/A"), ("q", 1, "/c")], "run_id string, page_id long, url string")
    assert [r["url"] for r in runs.recorded_pages(pages, F.lit("r")).collect()] == ["/A", "/b"]
    shots = spark.createDataFrame([("r", 1, b"x", 9), ("r", 3, b"x", 9), ("q", 1, b"x", 7)], "run_id string, page_id long, picture binary, byte_size long")
    ran = spark.createDataFrame([("r", "p", ("b",), 2), ("q", None, None, 1)], "run_id string, project_id string, visual_summary struct<baseline_run_id:string>, pages_crawled long")
    projects = spark.createDataFrame([("p", "c", ["#m"])], "project_id string, baseline_run_id string, mask_selectors array<string>")
    got = {r["run_id"]: r for r in runs.recorded_snapshots(shots, pages, ran, projects).collect()}
    assert "picture" not in got["r"] and (got["r"]["url"], got["r"]["project_baseline"], got["r"]["mask_selectors"], got["r"]["visual_summary"]["baseline_run_id"]) == ("/b", "c", ["#m"], "b")
    assert (got["q"]["url"], got["q"]["project_baseline"], got["q"]["visual_summary"]) == ("/c", None, None)


def test_trend_lists_what_found_anything_before_what_found_nothing_then_by_name(spark):
    none = ([], [], [])
    rows = [("p", "a", 1, True, none, ["d", "B", "a", "c"]), ("p", "b", 2, True, none, ["d", "B", "a", "c"])]
    ran = spark.createDataFrame(rows, "project_id string, run_id string, created_at int, crawl_complete boolean, scope struct<include_paths:array<string>,exclude_paths:array<string>,locales:array<string>>, rule_set array<string>")
    found = spark.createDataFrame([("a", "c"), ("b", "c"), ("a", "B"), ("b", "B"), ("a", "B"), ("b", "B"), ("b", "d")], "run_id string, type string")
    assert [r["type"] for r in runs.trend(ran, found).orderBy("place").collect()] == ["d", "B", "c", "a"]
