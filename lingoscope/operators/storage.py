"""Tables kept between the steps of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; one of our own only on a single machine that names none."""
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
        held = spark.sparkContext.getCheckpointDir()
    return held


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there, and
    a lost executor costs nothing that was written.

    A file holds at most ``rows`` rows, where they are so alike that a file of many is
    small, and would be read by one task whatever is made of it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write if rows is None else df.write.option("maxRecordsPerFile", rows)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spread(df: DataFrame, key: str, rows: int = 10_000) -> DataFrame:
    """``df`` dealt by ranges of ``key`` to tasks of about ``rows`` rows: for small rows, all in one file, of which much is made."""
    return df.repartitionByRange(1 + df.count() // rows, key)


def parts_for(*tables: DataFrame, rows: int = 100_000) -> int:
    """Into how many parts work on ``tables`` goes, so that a part holds about ``rows`` of their rows however many there are."""
    return 1 + sum(t.count() for t in tables) // rows


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written by buckets of ``key``, so that joins on it don't move the table again."""
    spark = df.sparkSession
    name, path = f"bucketed_{uuid.uuid4().hex}", f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stored_at, out._named = path, name
    return out


def present(*tables: DataFrame) -> bool:
    """Whether the files of all these ``stored`` tables are still there."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        if not at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return False
    return True


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``stored`` or ``bucketed`` gave and that nothing will read again."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            if hasattr(table, "_named"):
                table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._named}")
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
