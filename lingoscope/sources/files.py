"""Files of fetched bytes (pictures, sitemaps) as tables.

Files lie in folders ``run_id=...``, each named by the percent-encoded address that it
was fetched from and an ending.  Conditions on ``run_id`` choose folders and conditions
on ``length`` and ``modificationTime`` choose files before any bytes are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoscope.sources import sitemap

SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("run_id", T.StringType())]
)


def fetched(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """(run_id, path, modificationTime, length, content) of the files below ``root`` with an ending."""
    return spark.read.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", f"*{ending}").load(root)


def address(path: Column, ending: str) -> Column:
    """The address that a file's name encodes."""
    name = F.substring_index(path, "/", -1)
    return F.url_decode(F.replace(F.substring(name, F.lit(1), F.length(name) - len(ending)), F.lit("+"), F.lit("%2B")))


def sitemaps(spark: SparkSession, root: str, ending: str = ".xml.gz") -> DataFrame:
    """(run_id, sitemap, text): text is NULL where a file is broken or too large once inflated."""
    return fetched(spark, root, ending).select("run_id", address(F.col("path"), ending).alias("sitemap"), sitemap.decoded("content").alias("text"))


def pictures(spark: SparkSession, root: str, ending: str = ".png") -> DataFrame:
    """(run_id, url, length, picture)."""
    return fetched(spark, root, ending).select("run_id", address(F.col("path"), ending).alias("url"), "length", F.col("content").alias("picture"))
