"""Runs of events: bursts and rates of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(df: DataFrame, key: list[str], order: list[str], failed: Column, least: int) -> DataFrame:
    """(key, first, last, length) of unbroken runs of failures of at least ``least``."""
    seq = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_f", failed).withColumn("_n", F.row_number().over(seq))
    rows = rows.where("_f").withColumn("_i", F.col("_n") - F.row_number().over(seq))
    return rows.groupBy(*key, "_i").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_i")


def stopped_by_rate(df: DataFrame, key: list[str], order: list[str], failed: Column, rate: float, sample: int) -> DataFrame:
    """(key, at, seen, failures): where the share of failures so far first reaches ``rate``, after ``sample`` events."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"seen": F.count(F.lit(1)).over(so_far), "failures": F.sum(failed.cast("long")).over(so_far)})
    rows = rows.where((F.col("seen") >= sample) & (F.col("failures") >= F.col("seen") * rate))
    return rows.groupBy(*key).agg(F.min("seen").alias("seen"), F.min_by("failures", "seen").alias("failures"), F.min_by(order[0], "seen").alias("at"))
