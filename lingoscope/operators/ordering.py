"""Places in an order, of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.operators.storage import stored


def numbered(df: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] = (), keep: tuple[Column | str, ...] = ("*",)) -> DataFrame:
    """``keep`` of ``df`` and ``name``: a row's place, from 1, among all rows or those equal in ``by``.

    Rows are sorted by ranges; a row's place is what the ranges before hold and its
    place in its own.  So no task has more than a range, and only counts are added up.
    """
    order = [*by, *order]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select(*keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth")))
    counts = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_part", (before - F.col("first") + 1).alias("_start"))
    starts = starts if by else F.broadcast(starts)  # a row for each range
    return ranged.join(starts, [*by, "_part"]).withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")
