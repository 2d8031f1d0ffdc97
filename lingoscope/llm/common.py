"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; fold 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def bounded_sample(rows: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """At most ``limit`` rows, picked by a hash of their ids.

    A threshold on the hash leaves about half as many again as are wanted, so that no
    task has more than its share to hand on for the final order.
    """
    total = rows.count()
    h = F.xxhash64(id_col)
    if total > 1.5 * limit:
        rows = rows.where(h < int(-(2**63) + 2**64 * (1.5 * limit / total)))
    return rows.orderBy(h, *rows.columns).limit(limit)


def least_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The columns in ``held``, of rows with equal keys those that come first in the columns' order.

    Columns that have no order (maps) decide nothing: with one of these, any row stays.
    """
    if any(kind in rows.schema["held"].dataType.simpleString() for kind in ("map<", "variant")):
        return rows.dropDuplicates(list(keys)).select("held.*")
    return rows.groupBy(*keys).agg(F.min("held").alias("held")).select("held.*")


def utf8_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after another, and the rows' bounds.

    A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if bounds else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = bounds[0] if len(bounds) else 0
    return data[first : bounds[-1]], bounds - first


def byte_sized(column: pa.Array, most: int):
    """Slices (start, length) of a column of texts that hold about ``most`` bytes, a row at least."""
    _, bounds = utf8_of(column)
    start, n = 0, len(bounds) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        stop = min(stop, n)
        yield start, stop - start
        start = stop


def text_lists(column: pa.Array, most: int = 1 << 20):
    """(start, texts): a column's texts as strings, a slice of about ``most`` bytes at a time; a null is an empty text."""
    for start, n in byte_sized(column, most):
        yield start, [t or "" for t in column.slice(start, n).to_pylist()]


def give_back() -> None:
    """Returns memory that isn't used to the system, that of Arrow and (with glibc) of the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sparing(function):
    """For a function over a task's batches: no search for reference cycles while it runs.

    Code that makes many small objects and no cycles spends half its time in that
    search.  It is made up for after the task, and memory that isn't used is given
    back, since workers serve many tasks and wait between them.
    """

    def run(batches):
        gc.disable()
        try:
            yield from function(batches)
        finally:
            gc.enable()
            give_back()

    return run
