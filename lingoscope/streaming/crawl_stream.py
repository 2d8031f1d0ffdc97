"""Crawl pages as they arrive: counts, one row for each address, and when to stop.

The model has no stream of its own beyond pages that are recorded one by one;
these are the same operators over an unbounded table of such records
(run_id, url, fetched_at, http_status, fetch_error).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.schema import FAILURE_BURST, FAILURE_RATE, FAILURE_SAMPLE


def failed():
    """A failure that may pass: no answer, or the server's own error."""
    return F.col("fetch_error").isNotNull() | (F.coalesce("http_status", F.lit(0)) >= 500)


def pages_by_window(pages: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(run_id, start, pages, failures) for tumbling windows of event time; late records count until the watermark."""
    rows = pages.withWatermark("fetched_at", late)
    counts = rows.groupBy("run_id", F.window("fetched_at", window).alias("w")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(failed()).alias("failures"))
    return counts.select("run_id", F.col("w.start").alias("start"), "pages", "failures")


def each_address_once(pages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first record of each address of a run; its memory of an address ends with the watermark."""
    return pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["run_id", "url"])


STATE = "seen long, failures long, burst long, stopped boolean"
STOPS = "run_id string, seen long, failures long, reason string"


def stops(pages: DataFrame, burst: int = FAILURE_BURST, rate: float = FAILURE_RATE, sample: int = FAILURE_SAMPLE) -> DataFrame:
    """(run_id, seen, failures, reason): the first moment at which a run should stop.

    A run stops at ``burst`` failures in a row, or when a share of ``rate`` failed
    after ``sample`` records.  The state of a run is four numbers.
    """
    rows = pages.select("run_id", "fetched_at", "url", failed().alias("failed"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, failures, run, stopped = state.get if state.exists else (0, 0, 0, False)
        reason = None
        if not stopped:
            arrived = pd.concat(list(batches)).sort_values(["fetched_at", "url"])
            for bad in arrived["failed"]:
                seen, failures, run = seen + 1, failures + bool(bad), run + 1 if bad else 0
                if run >= burst or (seen >= sample and failures >= seen * rate):
                    reason, stopped = ("burst" if run >= burst else "rate"), True
                    break
        state.update((int(seen), int(failures), int(run), bool(stopped)))
        if reason:
            yield pd.DataFrame({"run_id": [key[0]], "seen": [int(seen)], "failures": [int(failures)], "reason": [reason]})

    return rows.groupBy("run_id").applyInPandasWithState(step, STOPS, STATE, "append", "NoTimeout")
