"""Tables that queries of a session share, and grids over families of any size."""

import random

from pyspark.sql import functions as F

from lingoscope.operators.storage import discard
from lingoscope.plans import catalogue, reports, rule_queries

PAGES = "run_id string, url string, locale string, group_key string, http_status int, fetch_error string"
SF = "/root/testdata/sf0.001"


def plain_cells(pages, expected):
    """The grid of one run by loops."""
    answers = lambda own, asked: own is not None and (own.lower() == asked.lower() or own.lower().startswith(asked.lower() + "-"))
    columns = expected + sorted({p[2] for p in pages if p[2] is not None and not any(answers(p[2], e) for e in expected)})
    out = {}
    for key in {p[3] for p in pages}:
        members = sorted((p for p in pages if p[3] == key), key=lambda p: p[1])
        if len(members) < 2:
            continue
        cells = []
        for at, asked in enumerate(columns):
            page = next((m for m in members if answers(m[2], asked)), None)
            if page is None:
                cells.append("missing" if at < len(expected) else "not-expected")
            else:
                cells.append("broken" if page[5] is not None or page[4] is None or page[4] >= 400 else "present")
        out[key] = cells
    return out


def test_cells_agree_with_loops_and_one_family_may_hold_most_pages(spark):
    rng = random.Random(5)
    rows = [
        ("r", f"/{i:05d}", rng.choice(["en", "en-GB", "de", "DE-at", "fr", "pt", None]), "hot" if rng.random() < 0.6 else f"k{rng.randrange(150)}", rng.choice([200, 200, 404, None]), rng.choice([None, None, "timeout"]))
        for i in range(1500)
    ]
    run = spark.createDataFrame([("r", ["en", "de", "it"])], "run_id string, expected_locales array<string>")
    cells = reports.parity_cells(spark.createDataFrame(rows, PAGES), run)
    got = {r["group_key"]: r["cells"] for r in cells.collect()}
    assert got == plain_cells(rows, ["en", "de", "it"])


def test_a_shared_table_that_is_gone_is_written_again(spark):
    rule = lambda: sorted(tuple(r) for r in catalogue.QUERIES["rule_missing_locale"](spark, SF).collect())
    before = rule()
    crawl = rule_queries.shop(spark, SF)
    assert rule_queries.shop(spark, SF) is crawl
    assert len(crawl.written()) > 3
    discard(crawl.members)
    assert rule() == before
    assert rule_queries.shop(spark, SF) is not crawl
    discard(rule_queries.shop(spark, SF).kept["shop_facts"])
    assert rule() == before
