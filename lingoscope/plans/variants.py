"""Language variants: families of pages that declare each other, and their locales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions.collation import collated
from lingoscope.functions.locale import is_language_tag, locale_from_path
from lingoscope.functions.urls import path_of
from lingoscope.operators.graph import connected_components
from lingoscope.operators.storage import stored

_SEP = "\u0000"


def declarations(pages: DataFrame) -> DataFrame:
    """(run_id, url, locale, target): every declared alternate, ``x-default`` included."""
    return pages.select("run_id", "url", F.explode("hreflang").alias("locale", "target"))


def families(pages: DataFrame) -> DataFrame:
    """(run_id, url, locale, group_key) for every page.

    Pages belong together if a declaration, in either direction, connects them;
    only crawled targets count.  The key is the smallest address, in code order.
    A page's locale is what it declares for itself, else what the first page (in
    order of address) declares for it, else what its path implies.
    """
    key = F.concat("run_id", F.lit(_SEP), "url")
    known = pages.select("run_id", F.col("url").alias("target"))
    edges = stored(declarations(pages).join(known, ["run_id", "target"], "left_semi"))
    parts = connected_components(edges.select(key.alias("src"), F.concat("run_id", F.lit(_SEP), "target").alias("dst")))
    at = F.split("node", _SEP)
    parts = parts.select(at[0].alias("run_id"), at[1].alias("url"), F.split("component", _SEP)[1].alias("group_key"))

    named = edges.where(is_language_tag(F.col("locale")))
    own = named.where("url = target").groupBy("run_id", "url").agg(F.min("locale").alias("own"))
    given = named.where("url <> target").groupBy("run_id", F.col("target").alias("url")).agg(F.min_by("locale", F.struct("url", "locale")).alias("given"))
    rows = pages.select("run_id", "url").join(parts, ["run_id", "url"], "left").join(own, ["run_id", "url"], "left").join(given, ["run_id", "url"], "left")
    return rows.select("run_id", "url", F.coalesce("own", "given", locale_from_path(path_of(F.col("url")))).alias("locale"), F.coalesce("group_key", "url").alias("group_key"))


def inbound_links(pages: DataFrame) -> DataFrame:
    """(run_id, url, inbound): how many other crawled pages link to each page."""
    links = pages.select("run_id", F.col("url").alias("src"), F.explode("links").alias("url")).where("src <> url").distinct()
    counted = links.join(pages.select("run_id", "url"), ["run_id", "url"], "left_semi").groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("run_id", "url").join(counted, ["run_id", "url"], "left").select("run_id", "url", F.coalesce("n", F.lit(0)).alias("inbound"))


def render_sample(pages: DataFrame, runs: DataFrame, cap: int) -> DataFrame:
    """(run_id, url, place): which pages to measure, at most ``cap`` of each run.

    The entry page first, then in turn one page of each expected locale, most
    linked first, then whatever is most linked.  A page that several locales
    could take is taken once, at its first turn.
    """
    from lingoscope.functions.locale import answers

    usable = pages.where("fetch_error is null and http_status < 400 and content.is_html").select("run_id", "url")
    rows = usable.join(inbound_links(pages), ["run_id", "url"]).join(families(pages).select("run_id", "url", "locale"), ["run_id", "url"])
    rows = rows.join(runs.select("run_id", "entry_url", "expected_locales"), "run_id")
    turns = rows.select("run_id", "url", "inbound", "locale", F.posexplode("expected_locales").alias("locale_ix", "expected")).where(answers(F.col("locale"), F.col("expected")))
    depth = F.row_number().over(Window.partitionBy("run_id", "locale_ix").orderBy(F.desc("inbound"), *collated("url")))
    turns = turns.select("run_id", "url", F.lit(1).alias("phase"), depth.alias("depth"), "locale_ix")
    entry = rows.where("url = entry_url").select("run_id", "url", F.lit(0).alias("phase"), F.lit(0).alias("depth"), F.lit(0).alias("locale_ix"))
    fill_depth = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("inbound"), *collated("url")))
    fill = rows.select("run_id", "url", F.lit(2).alias("phase"), fill_depth.alias("depth"), F.lit(0).alias("locale_ix"))
    first = entry.unionByName(turns).unionByName(fill).groupBy("run_id", "url").agg(F.min(F.struct("phase", "depth", "locale_ix")).alias("turn"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("turn", "url"))
    return first.select("run_id", "url", place.alias("place")).where(F.col("place") <= cap)
