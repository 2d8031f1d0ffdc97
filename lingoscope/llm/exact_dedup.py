"""Exact duplicates: 128-bit content hash, with the bytes compared inside a group.

Built from DataFrame functions only.

* A group is first keyed by the MD5 of the normalised text (128 bits), then by
  the text itself: the aggregate's key comparison is the comparison of bytes, so
  two texts that merely collide stay two groups.  Copies are folded on the map
  side, so a text that makes up a third of all rows reaches its reducer as one
  row for each map task.
* Rows find their group by (MD5, SHA-256).  Should two *different* texts of one
  group ever share both, the job stops with an error instead of merging them.
* The rows of a group of very many copies are salted before that; the groups'
  keys, of which there can only be a bounded number, are broadcast for it.

Cases: null text counts as empty; rows with equal ids are separate rows of the
group; a null id never represents a group unless it has no other; input columns
may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.common import least_of_each, narrow
from lingoscope.operators.storage import stored

LARGE = 1_000  # copies from which a group's rows are salted
MOST_LARGE = 50_000  # such groups at most: above, only those of rows / MOST_LARGE copies are
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """A row for every input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest (default) or the largest id of a group stays.
    With repeated ids, ``kept`` holds for each row that bears the id.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    rows = narrow(docs, id=id_col, text=text_col).select("id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    hashed = rows.select("id", "norm", hash_of(F.col("norm")).alias("h128"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    texts = hashed.groupBy("h128", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("sha").alias("sha"))
    groups = texts.groupBy("h128", "sha").agg(
        F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
    )
    groups = groups.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
    groups = stored(groups.drop("texts"))
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    part = max(LARGE, rows // MOST_LARGE)
    key = ["h128", "sha"]
    salts = F.expr(f"cast(group_size div {part} as int)")
    # at most MOST_LARGE rows, since the groups' sizes add up to the number of rows
    large = groups.where(F.col("group_size") >= part).select(*key, salts.alias("salts"))
    members = hashed.select("id", *key).join(F.broadcast(large), key, "left")
    members = members.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).otherwise(F.lit(0))).drop("salts")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return members.join(dealt, [*key, "salt"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each group, with all its columns: the one whose id represents it.

    Of rows that have that id and an equal text, the least in the order of its columns stays.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    kept = stored(groups.groupBy("kept_id", "kept_sha").agg((F.count(F.lit(1)) > 1).alias("twins")))
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    rows = docs.select(docs[id_col].alias("id"), sha.alias("sha"), F.struct(*[docs[c] for c in docs.columns]).alias("held"))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["sha"] == kept["kept_sha"])
    some = rows.join(kept, same).select("id", "sha", "held", "twins")
    single = some.where("not twins").select("held.*")
    if kept.where("twins").isEmpty():
        return single
    return single.unionByName(least_of_each(some.where("twins"), "id", "sha"))
