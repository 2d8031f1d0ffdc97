"""Sitemaps: decoding bodies, reading entries, and sorting them against a run's scope."""

from __future__ import annotations

import html
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoscope.functions.urls import in_scope, origin_of, over_lists, page_url, path_of, resolved
from lingoscope.operators.storage import stored
from lingoscope.schema import MAX_SITEMAPS

#: Fixed limits of a sitemap document, as its format states them.
MAX_BYTES, MAX_URLS = 50 * 1024 * 1024, 50_000


def inflate(body: bytes | None) -> str | None:
    """A sitemap's text, unzipped if it is gzip; NULL if it is broken or too large."""
    if body is None:
        return None
    if body[:2] == b"\x1f\x8b":
        try:
            reader = zlib.decompressobj(31)
            body = reader.decompress(body, MAX_BYTES + 1)
        except zlib.error:
            return None
    return None if len(body) > MAX_BYTES else body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series) -> pd.Series:
    return body.map(inflate)


def _loc(raw: str) -> str:
    raw = re.sub(r"^\s*<!\[CDATA\[(.*?)\]\]>\s*$", r"\1", raw, flags=re.S)
    return html.unescape(raw).strip()


def _plain_loc(raw: str) -> str:
    return _loc(raw) if "&" in raw or "<" in raw else raw.strip()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _locs(raw: pa.Array) -> pa.Array:
    return over_lists(raw, raw, lambda _: _plain_loc, pa.string())


def parse(texts: DataFrame, run_col: str = "run_id", text_col: str = "text", base_col: str | None = None) -> DataFrame:
    """(run_id, is_index, place, raw, url): the addresses of sitemaps, or of the sitemaps that an index names.

    ``place`` counts a document's addresses from 1, without empty ones.  Relative
    addresses stand for those beside ``base_col``, and for none without it.
    """
    found = F.regexp_extract_all(text_col, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc\s*>"), 1)
    told = texts.where(F.col(text_col).isNotNull()).select(
        F.col(run_col).alias("run_id"), F.col(text_col).rlike(r"(?i)<sitemapindex\b").alias("is_index"), F.slice(F.filter(_locs(found), lambda x: x != ""), 1, MAX_URLS).alias("raws"),
        *([F.col(base_col).alias("base")] if base_col else []),
    )
    meant = resolved(F.col("raws"), F.col("base")) if base_col else F.transform("raws", page_url)
    pairs = told.select("run_id", "is_index", F.posexplode(F.arrays_zip("raws", meant.alias("urls"))).alias("at", "pair"))
    return pairs.select("run_id", "is_index", (F.col("at") + 1).alias("place"), F.col("pair.raws").alias("raw"), F.col("pair.urls").alias("url"))


def reconciled(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Entries with ``part``: unusable, cross_origin, out_of_scope or comparable, the first that holds."""
    rows = entries.join(runs.select("run_id", "base", "include_paths", "exclude_paths"), "run_id")
    part = (
        F.when(F.col("url").isNull(), "unusable")
        .when(origin_of(F.col("url")) != origin_of(F.col("base")), "cross_origin")
        .when(~in_scope(path_of(F.col("url")), F.col("include_paths"), F.col("exclude_paths")), "out_of_scope")
        .otherwise("comparable")
    )
    return rows.withColumn("part", part).drop("base", "include_paths", "exclude_paths")


def read_tree(roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """(run_id, raw, url, source, place): entries of the sitemaps that ``roots`` (run_id, sitemap) name, through their indexes.

    ``bodies`` (run_id, sitemap, text) are what was fetched, an address of a run once; a
    text that is NULL isn't a sitemap.  Sitemaps are read level by level, each once, in the order in which they
    are named (roots by their ``place`` if they have one, then by address), at most
    ``MAX_SITEMAPS`` of a run.  Its entries are the first ``MAX_URLS``, numbered by
    ``place`` in the order of reading.
    """
    base = bodies.withColumn("sitemap", page_url(F.col("sitemap")))
    told = parse(base.select(F.struct("run_id", "sitemap").alias("source"), "sitemap", "text"), "source", base_col="sitemap")
    told = stored(told.select("run_id.*", "is_index", "place", "raw", "url").withColumnRenamed("sitemap", "source"))
    known = stored(base.where("text is not null").select("run_id", "sitemap").distinct())

    def in_turn(named: DataFrame, read: DataFrame | None) -> DataFrame:
        """The sitemaps of a level that are still read, with their number in the run."""
        first = named.groupBy("run_id", "sitemap").agg(F.min("turn").alias("turn")).join(known, ["run_id", "sitemap"])
        before = F.lit(0)
        if read is not None:
            first = first.join(read, ["run_id", "sitemap"], "left_anti").join(read.groupBy("run_id").agg(F.max("nth").alias("before")), "run_id")
            before = F.col("before")
        nth = before + F.row_number().over(Window.partitionBy("run_id").orderBy("turn", "sitemap"))
        return stored(first.withColumn("nth", nth).where(F.col("nth") <= MAX_SITEMAPS).select("run_id", "sitemap", "nth"))

    place = F.col("place") if "place" in roots.columns else F.lit(0)
    level = read = in_turn(roots.select("run_id", page_url(F.col("sitemap")).alias("sitemap"), F.struct(F.lit(0), place.cast("long")).alias("turn")), None)
    for _ in range(1, MAX_SITEMAPS):
        above = level.select("run_id", F.col("sitemap").alias("source"), "nth")
        named = told.where("is_index and url is not null").join(above, ["run_id", "source"]).select("run_id", F.col("url").alias("sitemap"), F.struct("nth", "place").alias("turn"))
        level = in_turn(named, read)
        if level.isEmpty():
            break
        read = read.unionByName(level)
    # an entry's number is what the sitemaps before hold, of which there are few, and its own place
    entries = told.where("not is_index").join(read.withColumnRenamed("sitemap", "source"), ["run_id", "source"])
    held = entries.groupBy("run_id", "source", "nth").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("run_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entries = entries.join(held.select("run_id", "source", start.alias("start")), ["run_id", "source"]).withColumn("place", F.col("start") + F.col("place"))
    return entries.where(F.col("place") <= MAX_URLS).select("run_id", "raw", "url", "source", "place")
