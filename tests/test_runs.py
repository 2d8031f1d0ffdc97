import struct
import zlib

import numpy as np
import pytest
from crawls import BASE
from pyspark.sql import functions as F

from lingoscope.operators import graph
from lingoscope.operators.graph import connected_components, reachable
from lingoscope.operators.intervals import bursts, stopped_by_rate
from lingoscope.plans import catalogue, findings, reports, runs
from lingoscope.schema import RULES
from lingoscope.sources import snapshots

RUN = "project_id string, run_id string, created_at int, crawl_complete boolean, scope struct<include_paths:array<string>,exclude_paths:array<string>,locales:array<string>>, rule_set array<string>"
SCOPE = ([], [], ["en"])


def run_rows(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], RUN)


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 30), (30, 31)] + [(i, i + 1) for i in range(100, 140)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[x] for x in (1, 2, 3, 30, 31)} == {1} and {got[x] for x in (7, 8, 9)} == {7} and got[5] == 5 and {got[x] for x in range(100, 141)} == {100}
    assert connected_components(edges.where("false")).count() == 0
    far = {r["node"]: r["depth"] for r in reachable(edges, spark.createDataFrame([(1,)], "n long")).collect()}
    assert far == {1: 0, 2: 1, 3: 2, 30: 3, 31: 4}


def test_reach_has_no_end_but_the_last_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "CUT_STEPS", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(110)] + [(110, 0), (50, 3)], "src long, dst long")
    one = spark.createDataFrame([(0,)], "n long")
    assert {r["node"]: r["depth"] for r in reachable(edges, one).collect()} == {i: i for i in range(111)}
    monkeypatch.setattr(graph, "MAX_STEPS", 5)
    with pytest.raises(RuntimeError):
        reachable(edges, one)
    assert reachable(edges, one, max_depth=4).count() == 5


def test_frontier_closure_against_breadth_first_search(spark):
    sf = "/root/testdata/sf0.01"
    near = {}
    for r in catalogue._host_parts(spark, sf).collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    first = min(r["src"] for r in catalogue._host_parts(spark, sf).collect())
    want, rim = {first: 0}, [first]
    while rim:
        rim = sorted({n for x in rim for n in near[x]} - want.keys())
        want |= {n: max(want.values()) + 1 for n in rim}
    assert {r["node"]: r["depth"] for r in catalogue.frontier_closure(spark, sf).collect()} == want


def test_every_address_is_judged_once_in_its_own_run(spark, monkeypatch):
    rows = [(3, "https://a.test/en/1", "three"), (1, "https://a.test/en/1", "one"), (5, "https://b.test/en/1", "five"), (2, "http://a.test/en/1", "two")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = sorted(map(tuple, catalogue._one_of_each_address(pages).collect()))
    assert got == [("http://a.test", "http://a.test/en/1", 2, "two"), ("https://a.test", "https://a.test/en/1", 1, "one"), ("https://b.test", "https://b.test/en/1", 5, "five")]


def test_detect_findings_takes_all_pages(spark, monkeypatch):
    held = []
    monkeypatch.setattr(catalogue.rules, "detect", held.append)
    sf = "/root/testdata/sf0.01"
    catalogue.detect_findings(spark, sf)
    (crawl,) = held
    urls = {r["url"] for r in catalogue.table(spark, sf, "pages").select(catalogue.page_url(F.col("url")).alias("url")).collect()}
    assert sorted(r["url"] for r in crawl.pages.select("url").collect()) == sorted(urls)
    assert {r["base"] for r in crawl.runs.collect()} == {r["run_id"] + "/" for r in crawl.pages.select("run_id").distinct().collect()}


def test_comparability(spark):
    df = run_rows(spark, [("a", 1, True, SCOPE, ["x"]), ("b", 2, None, SCOPE, ["x"]), ("c", 3, False, SCOPE, ["x"]), ("d", 4, True, SCOPE, ["x"]), ("e", 5, True, SCOPE, ["x", "y"]), ("f", 6, True, (["/a"], [], ["en"]), ["y", "x"]), ("g", 7, True, (["/a"], [], ["en"]), ["x", "y", "x"])])
    got = {r["run_id"]: r["reason"] for r in runs.with_predecessor(df).collect()}
    assert got == {"a": "no_predecessor", "b": "not_recorded", "c": "not_recorded", "d": "incomplete_crawl", "e": "rules_changed", "f": "scope_changed", "g": None}


def test_comparison_is_a_multiset_match(spark):
    df = run_rows(spark, [("a", 1, True, SCOPE, ["no_hreflang"]), ("b", 2, True, SCOPE, ["no_hreflang"])])
    rows = [("a", 1, "no_hreflang", None, '{"url":"x"}'), ("a", 2, "no_hreflang", None, '{"url":"x"}'), ("a", 3, "no_hreflang", None, '{"url":"gone"}'), ("b", 1, "no_hreflang", None, '{"url":"x"}'), ("b", 2, "no_hreflang", None, '{"url":"new"}')]
    found = spark.createDataFrame(rows, "run_id string, ord long, type string, url string, detail string")
    got = sorted((r["run_id"], r["ord"], r["status"], r["reason"]) for r in runs.compare_runs(df, found).collect() if r["run_id"] == "b")
    assert got == [("b", 1, "still_present", None), ("b", 2, "new", None), ("b", 2, "resolved", None), ("b", 3, "resolved", None)]
    first = [(r["status"], r["reason"]) for r in runs.compare_runs(df, found).collect() if r["run_id"] == "a"]
    assert set(first) == {(None, "no_predecessor")}


def test_trend_tells_unchecked_from_zero(spark):
    df = run_rows(spark, [("a", 1, True, SCOPE, ["x"]), ("b", 2, True, SCOPE, ["x", "y"]), ("c", 3, False, SCOPE, ["x", "y"]), ("d", 4, True, SCOPE, ["x", "y"])])
    found = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("d", "x"), ("c", "x")], "run_id string, type string")
    got = {r["type"]: (r["cells"], r["found"], r["moved"], r["place"]) for r in runs.trend(df, found).collect()}
    assert got == {"y": ([None, 1, 0], 1, True, 1), "x": ([1, 1, 1], 3, False, 2)}


def test_retention(spark):
    rows = spark.createDataFrame([("p", f"r{i}", i, i == 5) for i in range(1, 6)], "project_id string, run_id string, created_at int, is_baseline boolean")
    assert [r["run_id"] for r in runs.runs_to_expire(rows, 3).collect()] == ["r1"]


def test_identity_covers_every_type_and_ignores_observations(spark):
    assert set(findings.IDENTITY) == set(RULES)
    rows = [("link_broken", '{"target":"t","httpStatus":404,"linkedFrom":["a"]}'), ("link_broken", '{"target":"t","httpStatus":500,"linkedFrom":["a","b"]}'), ("link_external_broken", '{"target":"t"}'), ("page_orphaned", '{"urls":["b","a"]}'), ("page_orphaned", '{"urls":["a","b"]}'), ("unheard_of", '{"b":"1","a":"2"}')]
    df = spark.createDataFrame(rows, "type string, detail string")
    keys = [r["k"] for r in df.select(findings.identity(F.col("type"), F.col("detail"), F.lit(None).cast("string")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] and len(set(keys)) == 4
    roles = df.select(findings.roles(F.col("type"), F.col("detail")).alias("r")).collect()
    assert (roles[1]["r"]["subject"], roles[1]["r"]["origin"]) == (["t"], ["a", "b"]) and roles[3]["r"]["origin"] == []


def test_correlation_keeps_every_finding_once(spark):
    detail = lambda *urls: '{"target":"t","linkedFrom":[%s]}' % ",".join(f'"{BASE}{u}"' for u in urls)
    rows = [("r", 1, "link_broken", None, detail("/en/")), ("r", 2, "link_broken", None, detail("/de")), ("r", 3, "link_external_broken", None, detail("/en")), ("r", 4, "link_broken", None, detail("/lost")), ("r", 5, "link_broken", None, detail("/lost")), ("r", 6, "certificate_problem", None, "{}"), ("r", 7, "link_broken", None, detail("/en", "/solo"))]
    found = spark.createDataFrame(rows, "run_id string, ord long, type string, url string, detail string")
    families = spark.createDataFrame([("r", BASE + u, BASE + g) for u, g in (("/en", "/de"), ("/de", "/de"), ("/solo", "/solo"))], "run_id string, url string, group_key string")
    out = reports.correlate(found, families)
    assert [r["ord"] for r in out.orderBy("ord").collect()] == [1, 2, 3, 4, 5, 6, 7]
    got = [(r["findings"], r["shape"]) for r in reports.problems(out).orderBy("place").collect()]
    assert sorted(got) == [([1, 2], "one-family"), ([4, 5], "same-pages")]


def test_bursts_and_rates(spark):
    marks = "0111110010" + "1" * 14
    df = spark.createDataFrame([("k", i, m == "1") for i, m in enumerate(marks)], "k string, at int, bad boolean")
    assert [(r["first"], r["length"]) for r in bursts(df, ["k"], ["at"], F.col("bad"), 5).orderBy("first").collect()] == [(1, 5), (10, 14)]
    r = stopped_by_rate(df, ["k"], ["at"], F.col("bad"), 0.3, 20).first()
    assert (r["at"], r["seen"]) == (19, 20)


def png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = []
    for y in range(h):
        kind = y % 5
        row, up = pixels[y].astype(int).ravel(), (pixels[y - 1] if y else np.zeros((w, n), int)).astype(int).ravel()
        left, upleft = np.concatenate([np.zeros(n, int), row[:-n]]), np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - upleft
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - upleft)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, upleft))
        guess = [np.zeros_like(row), left, up, (left + up) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pictures(spark):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (23, 17, 3)).astype(np.uint8)
    assert (snapshots.decode(png(noise)) == noise).all()
    white = np.full((64, 48, 3), 255, np.uint8)
    black = white.copy()
    black[5:15, 5:15] = 0
    black[50:60, 40:48] = 0
    a, b, tall, wide = png(white), png(black), png(np.full((70, 48, 3), 255, np.uint8)), png(np.full((64, 50, 3), 255, np.uint8))
    rows = [("same", a, "v", [], a, "v", []), ("differs", b, "v", ["m"], a, "v", ["m"]), ("tall", tall, "v", [], a, "v", []), ("wide", wide, "v", [], a, "v", []), ("missing", None, "v", [], a, "v", []), ("viewport", a, "w", [], a, "v", []), ("masks", a, "v", ["m"], a, "v", []), ("broken", b"x", "v", [], a, "v", [])]
    df = spark.createDataFrame([("r", *r) for r in rows], "run_id string, url string, picture binary, viewport string, masks array<string>, baseline binary, baseline_viewport string, baseline_masks array<string>")
    got = {r["url"]: r for r in snapshots.compare(df).collect()}
    assert {u: r["reason"] for u, r in got.items()} == {"same": None, "differs": None, "tall": None, "wide": "width_differs", "missing": "missing", "viewport": "viewport_differs", "masks": "masks_differ", "broken": "unreadable"}
    assert (got["differs"]["changed_pixels"], got["differs"]["compared_pixels"]) == (180, 64 * 48) and got["tall"]["changed_pixels"] == 0 and got["tall"]["height_delta"] == 6
    assert [tuple(r) for r in got["differs"]["regions"]] == [(0, 0, 16, 16), (32, 48, 16, 16)]


def test_streams(spark, tmp_path):
    import datetime as dt

    from lingoscope.streaming import crawl_stream

    start = dt.datetime(2026, 1, 1)
    rows = [("r", f"u{i}", start + dt.timedelta(seconds=i), 500 if 3 <= i < 9 else 200, None) for i in range(12)] + [("s", "u", start, 200, None), ("s", "u", start, 200, None)]
    schema = "run_id string, url string, fetched_at timestamp, http_status int, fetch_error string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert [tuple(r) for r in run(crawl_stream.stops(source()), "stops", "append")] == [("r", 8, 5, "burst")]
    assert len(run(crawl_stream.each_address_once(source()), "once", "append")) == 13
    counts = {r["run_id"]: (r["pages"], r["failures"]) for r in run(crawl_stream.pages_by_window(source()), "counts", "complete")}
    assert counts == {"r": (12, 6), "s": (2, 0)}
