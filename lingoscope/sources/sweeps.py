"""Sweeps over addresses outside a site, and over pictures, from the attempts that were made.

A sweep asks addresses in their order and stops by its own rules; what it recorded
after that doesn't count.  Attempts: (run_id, place, url, nth, http_status, fetch_error),
one row for each request: ``place`` orders a run's addresses (of equal places, the
address does), ``nth`` counts an address's requests from 1.  Limits: (run_id,
max_requests).  An attempt that isn't recorded has neither status nor error; of rows
alike in run, place, address and nth the greatest counts.

What comes before an address is summed by ranges of a run first, then within each
range, so a run of any length is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions.urls import page_url
from lingoscope.operators.storage import stored
from lingoscope.schema import FAILURE_RATE, FAILURE_SAMPLE

#: Statuses of a host that has no HEAD, and of one that asks to be left alone.
NO_HEAD, LEFT_ALONE = (405, 501), 429


def _asked(attempts: DataFrame, *more: str) -> DataFrame:
    """A row for each address: the request that answers (GET where HEAD isn't known) and the one after it."""
    one = F.struct("http_status", "fetch_error", *more)
    tries = attempts.groupBy("run_id", "place", "url").agg(*(F.max(F.when(F.col("nth") == n, one)).alias(f"t{n}") for n in (1, 2, 3)))
    no_head = F.coalesce(F.col("t1.http_status").isin(*NO_HEAD), F.lit(False))
    rows = tries.select("run_id", "place", "url", no_head.alias("no_head"), F.when(no_head, F.col("t2")).otherwise(F.col("t1")).alias("answer"), F.when(no_head, F.col("t3")).otherwise(F.col("t2")).alias("look"))
    return rows.withColumn("failed", F.col("answer.fetch_error").isNotNull())


def _until_stopped(rows: DataFrame, limits: DataFrame, sample: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """Rows (with ``requests`` and ``failed``) before their run's stop, and (run_id, complete)."""
    order = ["run_id", "place", "url"]
    failures = F.when(F.col("failed") & (F.col("requests") > 0), 1).otherwise(0)
    rows = stored(rows.withColumn("failures", failures).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("run_id", "part").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))
    parts = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("run_id", "part", *(F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"{c}_start") for c in ("requests", "failures")))
    own = Window.partitionBy("run_id", "part").orderBy("place", "url").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select(*order, "part", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(c) for c in ("requests", "failures"))).join(starts, ["run_id", "part"])
    made, lost = F.col("requests") + F.col("requests_start"), F.col("failures") + F.col("failures_start")
    ended = (made >= F.col("max_requests")) | ((made >= sample) & (lost / made >= rate))
    at = F.struct("place", "url")
    stops = before.join(limits.select("run_id", "max_requests"), "run_id", "left").where(ended).groupBy("run_id").agg(F.min(at).alias("stop"))
    runs = rows.select("run_id").unionByName(limits.select("run_id")).distinct().join(stops, "run_id", "left")
    kept = rows.join(stops, "run_id", "left").where(F.col("stop").isNull() | (at < F.col("stop")))
    return kept, runs.select("run_id", F.col("stop").isNull().alias("complete"))


def external_sweep(attempts: DataFrame, limits: DataFrame, sample: int = FAILURE_SAMPLE, rate: float = FAILURE_RATE) -> tuple[DataFrame, DataFrame]:
    """What was found out about outside addresses (schema.EXTERNAL), and (run_id, complete).

    A host that once answered 429 isn't asked again, and nothing is said of that address.
    A request without an answer is made once more: ``confirmed`` if that failed too.
    A run ends before an address once its requests reach the limit, or a share of
    ``rate`` of at least ``sample`` requests had failed: then it isn't complete.
    """
    # an address's identity has no default port, and http and https share their host
    rows = _asked(attempts).withColumn("host", F.nullif(F.regexp_extract(page_url(F.col("url")), "^https?://([^/]+)", 1), F.lit("")))
    refused = F.coalesce(F.col("answer.http_status") == LEFT_ALONE, F.lit(False))
    rows = stored(rows.withColumn("refused", refused))
    closed = rows.where("refused and host is not null").groupBy("run_id", "host").agg(F.min(F.struct("place", "url")).alias("closed"))
    rows = rows.join(closed, ["run_id", "host"], "left")
    asked = F.col("closed").isNull() | (F.struct("place", "url") <= F.col("closed"))
    requests = F.when(asked, 1 + F.col("no_head").cast("int") + F.col("failed").cast("int")).otherwise(0)
    kept, complete = _until_stopped(rows.withColumn("requests", requests), limits, sample, rate)
    found = kept.where("requests > 0 and not refused").select(
        "run_id", "url", F.when(F.col("failed"), F.col("look.http_status")).otherwise(F.col("answer.http_status")).alias("http_status"),
        F.when(F.col("failed"), F.coalesce("look.fetch_error", "answer.fetch_error")).alias("fetch_error"), (F.col("failed") & F.col("look.fetch_error").isNotNull()).alias("confirmed"),
    )
    return found, complete


def image_sweep(attempts: DataFrame, limits: DataFrame, sample: int = FAILURE_SAMPLE, rate: float = FAILURE_RATE) -> tuple[DataFrame, DataFrame]:
    """Bytes of pictures (schema.IMAGE_WEIGHTS) by their ``content_length`` header, and (run_id, complete).

    A picture whose answer isn't a 2xx has no row; one without a readable length has NULL.
    Failures aren't looked at again; a run ends as that of ``external_sweep``.
    """
    rows = _asked(attempts, "content_length")
    kept, complete = _until_stopped(rows.withColumn("requests", 1 + F.col("no_head").cast("int")), limits, sample, rate)
    length = F.regexp_extract(F.col("answer.content_length"), r"^\s*([+-]?\d{1,18})", 1)
    found = kept.where("not failed and answer.http_status between 200 and 299")
    return found.select("run_id", "url", F.when(length != "", length).cast("long").alias("bytes")), complete
