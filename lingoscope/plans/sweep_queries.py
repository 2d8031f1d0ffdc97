"""Sweeps over outside addresses and pictures whose attempts are the rows of ``events``, and sitemaps in the order of orders.

A user's events are a run, in the order of their ids; an event is an address that was
asked, and its value decides what each request to it gave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.plans.catalogue import query, table
from lingoscope.sources import sitemap, sweeps

#: An event as an address, in SQL that both engines read: ``v`` is what it meets, ``r`` its run's number.
_ASKED = """SELECT CAST(user_id AS VARCHAR(20)) AS run_id, event_id AS place, user_id AS r, CAST(floor(value * 100) AS BIGINT) % (CASE WHEN user_id % 7 = 0 THEN 45 ELSE 160 END) AS v,
    'http' || CASE WHEN event_id % 2 = 0 THEN 's' ELSE '' END || '://h' || CAST(event_id % 23 AS VARCHAR(20)) || '.example/' || CAST(event_id AS VARCHAR(20)) AS url FROM events"""
_LIMIT = "CASE WHEN r % 5 = 0 THEN 40 ELSE 1000000 END"
#: What ``v`` stands for: below 14 no answer (below 7 not the second time either), then HEAD unknown, left alone, gone.
_ANSWERS = [("v < 7", 0, "timeout", "timeout", None), ("v < 14", 0, "timeout", None, 200), ("v < 18", 405, None, None, 200), ("v < 20", 501, None, None, 404), ("v < 21", 429, None, None, None), ("v < 32", 404, None, None, None)]

_SWEPT = f"""WITH asked AS ({_ASKED}), met AS (SELECT *, {{left_alone}} AS refused, v < 14 AS failed, v >= 14 AND v < 20 AS no_head, regexp_extract(url, '//([^/]+)', 1) AS host FROM asked),
    closed AS (SELECT run_id, host, min(place) AS closed FROM met WHERE refused GROUP BY ALL),
    counted AS (SELECT met.*, coalesce(place <= closed, true) AS open, CASE WHEN coalesce(place <= closed, true) THEN {{requests}} ELSE 0 END AS n FROM met LEFT JOIN closed USING (run_id, host)),
    summed AS (SELECT *, coalesce(sum(n) OVER w, 0) AS made, coalesce(sum(CASE WHEN failed AND n > 0 THEN 1 ELSE 0 END) OVER w, 0) AS lost FROM counted WINDOW w AS (PARTITION BY run_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    stops AS (SELECT run_id, min(place) AS stop FROM summed WHERE made >= {_LIMIT} OR (made >= 20 AND lost / made >= 0.3) GROUP BY run_id),
    kept AS (SELECT summed.*, stop IS NULL AS complete FROM summed LEFT JOIN stops USING (run_id) WHERE (stop IS NULL OR place < stop) AND n > 0 AND NOT refused)
"""


def _attempts(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    asked = spark.sql(_ASKED)
    one = lambda nth, status, error: F.struct(F.lit(nth).alias("nth"), F.lit(status).cast("int").alias("http_status"), F.lit(error).cast("string").alias("fetch_error"))
    tries = F.when(F.lit(False), F.array(one(1, 200, None)))
    for when, first, error, again, second in _ANSWERS:
        later = [one(2, second, again)] if second or again else []
        tries = tries.when(F.expr(when), F.array(one(1, first or None, error), *later))
    tries = tries.otherwise(F.array(one(1, 200, None)))
    length = F.when(F.col("v") % 9 == 0, F.lit("unknown")).when(F.col("v") % 9 > 1, F.concat((F.col("v") * 9000).cast("string"), F.lit(" bytes")))
    return asked.select("run_id", "place", "url", "r", length.alias("content_length"), F.explode(tries).alias("t")).select("run_id", "place", "url", "r", "content_length", "t.*")


def _limits(attempts: DataFrame) -> DataFrame:
    return attempts.select("run_id", F.expr(_LIMIT).alias("max_requests")).distinct()


@query(_SWEPT.format(left_alone="v = 20", requests="1 + failed::INT + no_head::INT") + """SELECT run_id, url, CASE WHEN v < 7 THEN NULL WHEN v < 18 THEN 200 WHEN v < 32 THEN 404 ELSE 200 END AS http_status,
    CASE WHEN failed THEN 'timeout' END AS fetch_error, v < 7 AS confirmed, complete FROM kept""")
def sweep_external(spark, sf_dir):
    """Outside addresses as a sweep found them, with whether their run's sweep was complete."""
    attempts = _attempts(spark, sf_dir)
    found, complete = sweeps.external_sweep(attempts, _limits(attempts))
    return found.join(complete, "run_id")


@query(_SWEPT.format(left_alone="false", requests="1 + no_head::INT") + """SELECT run_id, url, CASE WHEN v % 9 > 1 THEN v * 9000 END AS bytes, complete FROM kept WHERE NOT failed AND (v < 18 OR v >= 32)""")
def sweep_images(spark, sf_dir):
    """Pictures as a sweep weighed them, with whether their run's sweep was complete."""
    attempts = _attempts(spark, sf_dir)
    found, complete = sweeps.image_sweep(attempts, _limits(attempts))
    return found.join(complete, "run_id")


@query("""WITH one AS (SELECT o_custkey AS r, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders),
    entry AS (SELECT r, o, nth, l_linenumber AS l FROM one JOIN lineitem ON l_orderkey = o WHERE nth < 50)
    SELECT r AS customer, 'https://shop.example/o' || o AS source, 'https://shop.example/i/' || o || '/' || l AS url, row_number() OVER (PARTITION BY r ORDER BY nth, l DESC) AS place FROM entry""")
def sitemap_in_order(spark, sf_dir):
    """Entries of a run's sitemaps in the order of reading: a customer's orders, dearest first, and each order's items from the last."""
    site = "https://shop.example"
    loc = lambda *path: F.concat(F.lit("<loc> /"), *path, F.lit(" </loc>"))
    inner = lambda root, parts: F.concat(F.lit(f"<{root}>"), F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["loc"]), "<loc></loc>"), F.lit(f"</{root}>"))
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").cast("string")
    index = orders.groupBy(F.col("o_custkey").alias("run_id")).agg(inner("sitemapindex", F.struct(-F.col("o_totalprice"), "o_orderkey", loc(F.lit("o"), key).alias("loc"))).alias("text"))
    bodies = index.select("run_id", F.lit(f"{site}/all").alias("sitemap"), "text")
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(inner("urlset", F.struct(-F.col("l_linenumber"), loc(F.lit("i/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("loc"))).alias("text"))
    bodies = bodies.unionByName(orders.join(lines, "o_orderkey").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit(f"{site}/o"), key).alias("sitemap"), "text"))
    return sitemap.read_tree(bodies.where(f"sitemap = '{site}/all'").select("run_id", "sitemap"), bodies).withColumnRenamed("run_id", "customer").select("customer", "source", "url", "place")
