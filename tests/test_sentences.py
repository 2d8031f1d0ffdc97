"""Sentences and states whose words are results."""

from pyspark.sql import functions as F

from lingoscope.functions import sentences
from lingoscope.plans import runs
from lingoscope.schema import RULES

SCOPE = "struct<include_paths:array<string>,exclude_paths:array<string>>"


def test_every_rule_has_both_labels():
    assert set(sentences.LABELS) == set(RULES)
    assert set(sentences.CLIENT_LABELS) == set(RULES)


def test_coverage(spark):
    rows = [(1, "whole_crawl", ([], []), "recorded"), (2, "page_limit", (["/de", "/fr"], ["/x"]), "not_recorded"), (3, "whole_crawl", None, "recorded")]
    df = spark.createDataFrame(rows, f"k int, crawl string, scope {SCOPE}, rules string")
    got = {r["k"]: r["s"] for r in df.select("k", sentences.coverage_sentences(F.col("crawl"), F.col("scope"), F.col("rules")).alias("s")).collect()}
    assert got[1] == got[3] == []
    assert got[2] == [
        "This check stopped at its page limit, so the site is larger than what was looked at. Some checks do not run on a partial crawl and report nothing here.",
        "This check was scoped to part of the site — limited to /de, /fr, excluding /x.",
        "Which checks ran was not recorded for this run, so a check type with nothing listed may mean it found nothing or may mean it did not run.",
    ]


def test_visual_change(spark):
    rows = [(1, 1234567, 98765432, [(0, 0, 16, 16), (5, 6, 40, 20)], True, -12, 0.0005), (2, None, 5, None, None, None, None), (3, 0, 1, [(1, 2, 3, 4)], False, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, a long, b long, r array<struct<x:int,y:int,width:int,height:int>>, c boolean, h int, t double")
    told = sentences.visual_change(*(F.col(c) for c in "abrcht"))
    got = {r["k"]: tuple(r["s"]) for r in df.select("k", told.alias("s")).collect()}
    assert got == {
        1: ("1,234,567 of 98,765,432 compared pixels differ, in 2 regions or more", ["40 × 20 at 5, 6", "16 × 16 at 0, 0"], "The page is 12px shorter than the baseline", "Reported above 0.05% of the compared area"),
        2: ("Differs from the baseline", [], None, None),
        3: ("0 of 1 compared pixels differ, in 1 region", ["3 × 4 at 1, 2"], None, "Reported above 100% of the compared area"),
    }


def test_whether_pictures_of_two_runs_compare(spark):
    kind = "struct<complete:boolean,baseline_run_id:string>"
    rows = [(1, None, (True, "b")), (2, (True, "b"), (False, "b")), (3, (True, "a"), (True, "b")), (4, (True, None), (True, "b")), (5, (True, "b"), (True, "b")), (6, (True, None), (True, None))]
    df = spark.createDataFrame(rows, f"k int, p {kind}, c {kind}")
    got = {r["k"]: r["s"] for r in df.select("k", runs.visual_comparability(F.col("p"), F.col("c")).alias("s")).collect()}
    assert got == {1: "not_recorded", 2: "incomplete_crawl", 3: "baseline_changed", 4: "baseline_changed", 5: None, 6: None}


def test_whether_a_comparison_is_shown(spark):
    df = spark.createDataFrame([(1, False, None), (2, True, "rules_changed"), (3, True, None)], "k int, p boolean, r string")
    got = {r["k"]: r["s"] for r in df.select("k", runs.comparison_state(F.col("p"), F.col("r")).alias("s")).collect()}
    assert got == {1: "none", 2: "refused", 3: "compared"}
