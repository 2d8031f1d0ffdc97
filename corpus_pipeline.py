"""The corpus pipeline: each stage's rows are written as Parquet and read by the next.

All stages but the last return the columns of ``documents``.  Toxic documents
go, one of each group of exact and of near copies stays, the rest is put in an
order that holds the sources' target weights at every point, and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingoscope.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from lingoscope.llm.common import table
from lingoscope.llm.queries import tokenizer_path
from lingoscope.operators.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, percent=75)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in files that follow each other in the mixed order."""
    mixed = mixing.mixed(docs, temperature=0.7)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows that follow each other in the mixed order, to within one packing group."""
    return packing.packed_in_order(mixing.written_in_order(docs.select("doc_id", "text"), "mix_position"), tokenizer_path(), "mix_position")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages fit models, verify sets and schedule blocks: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
