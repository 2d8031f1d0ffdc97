"""A table that a stream of pages fills exactly once, with a running count, in which a later observation of an address replaces an earlier one.

Each micro-batch is written to a folder of its own number, then entered in a ledger
(rows for each run and batch).  A batch that Spark runs again after a failure overwrites
its own folder and entry, so it adds nothing; a batch without an entry isn't read.
Replacing happens when the table is read: of an address's observations the one of the
last batch counts, within a batch the latest (of equal times, the greatest of the other
columns), so the stream keeps no state for addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

KEY = ["run_id", "url"]


def entered(path: str):
    """The sink: writes a batch of pages and its entry below ``path``, in the same place whenever it runs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/pages/batch={number}")
        held = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/pages/batch={number}")
        held.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages")).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return write


def append_once(pages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream ``pages`` (run_id, url, fetched_at, ...); start it to fill the table."""
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(entered(path))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, batch, pages, total): pages of each batch and of all up to it."""
    rows = spark.read.schema("run_id string, pages long, batch long").parquet(f"{path}/ledger")
    upto = Window.partitionBy("run_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("run_id", "batch", "pages", F.sum("pages").over(upto).alias("total"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """All pages of entered batches, with the number of their ``batch``."""
    done = spark.read.schema("batch long").parquet(f"{path}/ledger").select("batch").distinct()
    return spark.read.parquet(f"{path}/pages").withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last observation of each address of a run."""
    rows = observations(spark, path)
    rest = [c for c in rows.columns if c not in (*KEY, "batch", "fetched_at")]
    last = F.max(F.struct("batch", "fetched_at", *rest)).alias("last")
    return rows.groupBy(*KEY).agg(last).select(*KEY, "last.fetched_at", *[f"last.{c}" for c in rest])
