"""What must stay spread over tasks, however large the tables are."""

import json

import pytest
from crawls import BASE, crawl, page
from pyspark.sql import Window
from pyspark.sql import functions as F

from lingoscope.operators.ordering import numbered
from lingoscope import schema as S
from lingoscope.plans import reports, rule_queries, rules, shop_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_parts(spark):
    """Partitions stay apart though they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks(df) -> int:
    """How many tasks have rows of a result."""
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_places_are_those_of_one_window(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 37 % 11).alias("a"), (F.col("id") * 7919 % 2003).alias("b"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("c"))
    order = [F.desc("a"), F.col("c").isNull(), "b"]
    for by in ((), ("c",)):
        rows = rows if not by else rows.where("c is not null")
        want = rows.select("id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("n"))
        got = numbered(rows, order, "n", by=by, keep=("id", *by))
        assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert numbered(rows.where("false"), order, "n").count() == 0


def test_an_order_of_all_rows_is_no_single_task(spark, small_parts):
    assert tasks(shop_queries.shop_snapshots_in_order(spark, "/root/testdata/sf0.01")) > 1


def test_parts_and_a_crawls_tables_are_spread(spark, tmp_path, monkeypatch):
    """One file of many parts, each a page: made into pages, and read again, by several tasks."""
    spark.range(25_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert rule_queries.parts(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    monkeypatch.setattr(rules, "FILE_ROWS", 1000)
    pages = spark.range(3500).coalesce(1).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("url"), F.array(F.lit("a"), F.lit("b")).alias("links"))
    crawl = rules.Crawl(spark, pages, spark.createDataFrame([], S.RUNS))
    assert len(crawl.recorded.inputFiles()) == 4
    assert crawl.links.count() == 7000


def test_findings_without_a_cause_are_no_group(spark, small_parts):
    """Their sizes were once counted in one window over all of them."""
    some = spark.range(4000).select(F.lit("r").alias("run_id"), F.col("id").alias("ord"), F.lit("page_orphaned").alias("type"), F.lit(None).cast("string").alias("url"), F.lit('{"urls":["a"]}').alias("detail"))
    out = reports.correlate(some, spark.createDataFrame([], "run_id string, url string, group_key string"))
    assert out.where("size is null and problem is null").count() == 4000
    assert tasks(out) > 1


def test_blocks_of_a_family_from_one_grouping(spark):
    """A kind that is unknown on a page is neither there nor lacking; a page that is told twice is one member."""
    one = lambda path, *blocks: page(path, isolated=True, hreflang={"en": "/en/a", "de": "/de/a", "fr": "/fr/a"}, blocks=blocks)
    c = crawl(spark, [one("/en/a", "form", "table"), one("/de/a", "table"), one("/fr/a", "form", "table", "list")])
    differ = rules.RULES["content_structure_differs"](c)
    (row,) = [json.loads(r["detail"]) for r in differ.collect()]
    url = lambda *names: [f"{BASE}/{n}/a" for n in names]
    assert row["memberUrls"] == url("de", "en", "fr")
    assert row["differences"] == [{"block": "form", "present": url("en", "fr"), "absent": url("de")}, {"block": "list", "present": url("fr"), "absent": url("de", "en")}]
    assert "Generate" not in differ._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "module", "step"), [("shop_crawled", "fetched", "crawled"), ("shop_images", "html", "images")])
def test_markup_is_made_and_read_by_several_tasks(spark, tmp_path, monkeypatch, name, module, step):
    """All parts were one file, and so one task's pages."""
    spark.range(25_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")

    def met(rows, *_):
        raise StopIteration(rows.rdd.getNumPartitions())

    monkeypatch.setattr(getattr(shop_queries, module), step, met)
    with pytest.raises(StopIteration, match="3"):
        getattr(shop_queries, name)(spark, str(tmp_path))
