import datetime as dt
import os

from lingoscope.streaming import page_log

SCHEMA = "run_id string, url string, fetched_at timestamp, http_status int, fetch_error string"


def at(minute):
    return dt.datetime(2026, 1, 1, 0, minute)


def test_exactly_once_across_restarts(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        page_log.append_once(pages, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r["run_id"], r["batch"]): (r["pages"], r["total"]) for r in page_log.ledger(spark, path).collect()}

    arrive(("r", "/a", at(1), 503, None), ("r", "/b", at(1), 200, None), ("s", "/a", at(1), 200, None))
    assert run() == {("r", 0): (2, 2), ("s", 0): (1, 1)}
    arrive(("r", "/a", at(2), 200, None), ("r", "/c", at(2), None, "timeout"))
    want = {("r", 0): (2, 2), ("s", 0): (1, 1), ("r", 1): (2, 4)}
    assert run() == want and run() == want

    def now():
        return {(r["run_id"], r["url"]): r["http_status"] for r in page_log.current(spark, path).collect()}

    assert now() == {("r", "/a"): 200, ("r", "/b"): 200, ("r", "/c"): None, ("s", "/a"): 200}
    # the last batch was written but not committed: a restart runs it again, and nothing is added
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    assert run() == want and page_log.observations(spark, path).count() == 5 and len(now()) == 4


def test_later_observation_replaces_whatever_its_time(spark, tmp_path):
    write = page_log.entered(str(tmp_path))
    one = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    write(one(("r", "/a", at(5), 500, None), ("r", "/a", at(4), 200, None)), 0)
    assert page_log.current(spark, str(tmp_path)).first()["http_status"] == 500
    write(one(("r", "/a", at(3), 404, None)), 1)
    write(one(("r", "/a", at(3), 404, None)), 1)
    assert page_log.current(spark, str(tmp_path)).first()["http_status"] == 404
    assert page_log.observations(spark, str(tmp_path)).count() == 3
    # a batch that was cut off before its entry isn't read
    one(("r", "/z", at(9), 200, None)).write.parquet(f"{tmp_path}/pages/batch=2")
    assert page_log.current(spark, str(tmp_path)).count() == 1
