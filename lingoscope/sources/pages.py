"""Fetched pages as crawl facts, and redirect routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.functions import headers, html
from lingoscope.functions.binding import once
from lingoscope.functions.urls import page_url, resolved
from lingoscope.schema import HOP, MAX_REDIRECT_HOPS
from lingoscope.operators.storage import stored


def crawled(pages: DataFrame) -> DataFrame:
    """Facts (see schema.PAGES) of rows (run_id, url, http_status, fetch_error, content_type, headers, html).

    Rows may have a ``redirect_chain``; without one no page was redirected.  One pass over the HTML for everything but images, which are grouped by
    address.  A page without a body (an error) has empty facts, not NULL ones.
    """
    h = F.coalesce(F.col("html"), F.lit(""))
    is_html = F.coalesce(F.lower("content_type").rlike("html"), F.lit(False)) & F.col("html").isNotNull()
    chain = F.array().cast(f"array<{HOP}>")
    if "redirect_chain" in pages.columns:
        chain = F.coalesce(F.col("redirect_chain").cast(f"array<{HOP}>"), chain)
    rows = pages.withColumn("url", page_url(F.col("url"))).withColumn("redirect_chain", chain).select(
        "run_id", "url", "http_status", "fetch_error", "html", "redirect_chain", is_html.alias("is_html"),
        F.element_at("headers", "x-robots-tag").alias("x_robots_tag"), headers.security_headers(F.col("headers")).alias("security_headers"),
    )
    # one generated row for each page: what follows reads these facts without working them out again
    read = rows.select("*", F.inline_outer(F.array(F.struct(
        html.content(h, F.col("is_html")).alias("content"), once(html.head_region(h), html.head_facts).alias("head"), html.raw_hreflang(h).alias("declared"), html.raw_links(h).alias("anchors"), html.raw_canonicals(h).alias("named"),
    ))))
    read = read.select(
        "*", F.col("declared.locale").alias("locales"), resolved(F.col("declared.href"), F.col("url")).alias("targets"), resolved(F.col("anchors"), F.col("url")).alias("links"), resolved(F.col("named"), F.col("url")).alias("canonicals"),
    )
    pairs = F.filter(F.arrays_zip("locales", "targets"), lambda p: p["targets"].isNotNull())
    # the last declaration of a locale holds
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["locales"]), F.create_map(p["locales"], p["targets"])))
    facts = read.select(
        "run_id", "url", "http_status", "fetch_error", last.alias("hreflang"), F.array_distinct(F.array_compact("links")).alias("links"), "content",
        F.struct("head.title", "head.description", F.array_distinct(F.array_compact("canonicals")).alias("canonicals"), "head.robots").alias("metadata"),
        "x_robots_tag", "security_headers", "redirect_chain",
    )
    found = html.images(rows.where("is_html"), ["run_id", "url"])
    none = F.array().cast("array<string>")
    empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("undimensioned"), F.lit(0).alias("legacy"), none.alias("undimensioned_urls"), none.alias("legacy_urls"), none.alias("urls"))
    return facts.join(found, ["run_id", "url"], "left").withColumn("images", F.coalesce("images", F.when(F.col("content.is_html"), empty)))


def redirect_routes(hops: DataFrame, starts: DataFrame, max_hops: int = MAX_REDIRECT_HOPS) -> DataFrame:
    """Walks redirects (run_id, src, dst) from starts (run_id, url): (run_id, url, route, final, error).

    A route ends where nothing redirects; coming back to an address is a loop,
    and more than ``max_hops`` hops are too many.
    """
    state = starts.select("run_id", "url", F.array("url").alias("route"), F.col("url").alias("at"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("ended"))
    steps = hops.select("run_id", F.col("src").alias("at"), F.col("dst").alias("next"))
    for _ in range(max_hops + 1):
        moved = state.join(steps, ["run_id", "at"], "left")
        loop = F.array_contains("route", F.col("next"))
        going = ~F.col("ended") & F.col("next").isNotNull()
        too_many = going & ~loop & (F.size("route") > max_hops)
        error = F.when(going & loop, "Redirect loop.").when(too_many, "Too many redirects.").otherwise(F.col("error"))
        on = going & ~F.coalesce(loop, F.lit(False)) & ~too_many
        state = stored(moved.select("run_id", "url", F.when(going & ~too_many, F.array_append("route", F.col("next"))).otherwise(F.col("route")).alias("route"), F.when(on, F.col("next")).otherwise(F.col("at")).alias("at"), error.alias("error"), (~on).alias("ended")))
        if state.where("not ended").isEmpty():
            break
    return state.select("run_id", "url", "route", F.when(F.col("error").isNull(), F.col("at")).alias("final"), "error")
