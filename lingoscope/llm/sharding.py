"""Shards that all match the corpus's mixture: proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there; the
rank, as a fraction of the source's rows, orders the whole corpus, so any
stretch of that order holds each source in proportion.  Cutting the order in
equal parts gives shards whose row counts are at most one apart.

No rank is taken over a whole source or the whole corpus in one task.  A rank
is the rank inside a small bucket plus the counts of the buckets before it:
buckets of the hash for the source's rank, buckets of the fraction for the
global one.  There are as many buckets as make ``BUCKET_ROWS`` rows each, however
many rows one source holds; only tables of bucket counts are summed over a window.

The order is total up to rows that are alike in every column that it reads, so a
task that is run again after a lost executor gives each row the rank it had.

Cases: null text has size 1; null source is a source of its own; rows of one id
are ordered by their texts' checksums and sizes, and rows alike in these too are
interchangeable but keep one slot each; an empty table gives an empty result;
fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.llm.common import narrow

LEAST_BUCKETS = 64
BUCKET_ROWS = 1 << 14  # that one task sorts together, on average


def buckets_for(rows: int) -> int:
    """How many buckets deal out so many rows, even if all are of one source."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def ranked_in_source(rows: DataFrame, seed: int, buckets: int, ties: tuple[str, ...] = (), few_sources: bool = False) -> DataFrame:
    """Adds ``rank`` (from 0, in seeded order) and ``n_source`` to rows (id, source, ...).

    ``ties``: columns that tell rows of one id apart.  ``few_sources``: the caller
    has counted them, and sources times buckets is small enough to broadcast the
    counts, which saves wide rows a shuffle.
    """
    shuffled = rows.withColumn("order", F.xxhash64(F.lit(seed), F.col("id"), *ties))
    shuffled = shuffled.withColumn("_bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    counts = shuffled.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("source")).alias("n_source"),
    )
    starts = F.broadcast(starts) if few_sources else starts
    inside = Window.partitionBy("source", "_bucket").orderBy("order", "id", *ties)
    placed = shuffled.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = placed.join(starts, placed["source"].eqNullSafe(starts["_s"]) & (placed["_bucket"] == starts["_b"]))
    return joined.withColumn("rank", F.col("_start") + F.col("_inside")).drop("_s", "_b", "_start", "_inside", "_bucket")


def globally_ranked(rows: DataFrame, key: Column, ties: list[str], buckets: int) -> DataFrame:
    """Adds ``at``, the rank from 0 in the order of ``key`` (0 <= key < 1), then ``ties``; and ``n_all``."""
    keyed = rows.withColumn("key", key)
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") * buckets).cast("int"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(everything).alias("n_all"))
    inside = Window.partitionBy("bucket").orderBy("key", *ties)
    return keyed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, "bucket").withColumn("at", F.col("start") + F.col("inside"))


def stratified_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """A row for each document: id, source, size, text_crc32, law, shard, slot, grown_shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, id=id_col, text=text_col, source=source_col).select(
        "id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    buckets = buckets_for(docs.count())
    ranked = ranked_in_source(rows, seed, buckets, ("text_crc32", "size"))
    # (rank + 1/2) / n_source lies strictly between 0 and 1 and treats small and large sources alike
    placed = globally_ranked(ranked, (F.col("rank") + 0.5) / F.col("n_source"), ["order", "source", "id", "text_crc32", "size"], buckets)
    shard = F.expr(f"at * {shards} div n_all").cast("int")
    first = F.expr(f"(shard * n_all + {shards - 1}) div {shards}")  # the smallest rank that falls into the shard
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
