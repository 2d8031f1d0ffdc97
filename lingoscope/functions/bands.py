"""Labels and states of runs, vitals and pictures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingoscope.schema import MAX_MASKS, MAX_SELECTOR_CHARS, MIN_CHANGED_SHARE, VITALS


def cls(value: Column) -> Column:
    """A layout shift that was stored as text; NULL if it can't be read."""
    return value.try_cast("double")


def band(metric: str, value: Column) -> Column:
    good, poor = VITALS[metric]
    number = value.cast("double")
    return (
        F.when(number.isNull() | F.isnan(number), "unmeasured").when(number <= good, "good").when(number <= poor, "needs_improvement").otherwise("poor")
    )


def change_share(comparable: Column, changed: Column, compared: Column) -> Column:
    """Share of pixels that changed; NULL for a refused pair or one without pixels."""
    return F.when(F.coalesce(comparable, F.lit(False)) & (compared > 0), changed / compared)


def differs(comparable: Column, changed: Column, compared: Column) -> Column:
    return F.coalesce(change_share(comparable, changed, compared) >= MIN_CHANGED_SHARE, F.lit(False))


def region_overlay(regions: Column, width: Column, height: Column) -> Column:
    """Regions as fractions of a picture's size."""
    return F.transform(
        regions,
        lambda r: F.struct((r["x"] / width).alias("left"), (r["y"] / height).alias("top"), (r["width"] / width).alias("width"), (r["height"] / height).alias("height")),
    )


def crawl_coverage(complete: Column, page_limit: Column) -> Column:
    return (
        F.when(page_limit, "page_limit").when(complete == F.lit(False), "stopped_early").when(complete, "whole_crawl").otherwise("not_recorded")
    )


def scope_coverage(scope: Column) -> Column:
    return F.when(scope.isNull(), "not_recorded").when((F.size(scope["include_paths"]) == 0) & (F.size(scope["exclude_paths"]) == 0), "whole_site").otherwise("narrowed")


def rules_coverage(rule_set: Column) -> Column:
    """(kind, count)"""
    return F.struct(F.when(rule_set.isNull(), "not_recorded").otherwise("recorded").alias("kind"), F.when(rule_set.isNotNull(), F.size(rule_set)).alias("count"))


def sample_coverage(summary: Column) -> Column:
    return (
        F.when(summary.isNull(), "not_recorded").when(~summary["complete"], "unavailable").when(summary["chosen"] == 0, "nothing_measured").otherwise("sampled")
    )


def picture_coverage(summary: Column) -> Column:
    return (
        F.when(summary.isNull(), "not_recorded")
        .when(~summary["complete"], "unavailable")
        .when(summary["baseline_run_id"].isNull(), "no_baseline")
        .when(summary["watched"] == 0, "nothing_watched")
        .otherwise("watched")
    )


def run_status_label(status: Column, complete: Column, page_limit: Column) -> Column:
    done = status == "done"
    return (
        F.when(done & F.coalesce(page_limit, F.lit(False)), "Stopped at page limit").when(done & (complete == F.lit(False)), "Partial").otherwise(F.initcap(status))
    )


def visual_state(summary: Column, rows: Column, project_baseline: Column) -> Column:
    """The state of a run's pictures against the project's baseline of today."""
    return (
        F.when(summary.isNull(), "not_recorded")
        .when(~summary["complete"], "unavailable")
        .when(summary["baseline_run_id"].isNull() & project_baseline.isNull(), "no_baseline")
        .when(summary["baseline_run_id"].isNull(), "predates_baseline")
        .when((summary["watched"] == 0) | (rows == 0), "nothing_watched")
        .otherwise("compared")
    )


def performance_state(summary: Column, measured: Column, failed: Column, crawled: Column) -> Column:
    """(kind, coverage) of a run's browser measurements: counts of pages that were measured, that failed, and of all crawled."""

    def pages(n: Column) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, " page").otherwise(" pages"))

    of = F.when(crawled > 0, F.concat(F.lit(" of "), pages(crawled), F.lit(" crawled"))).otherwise("")
    base = F.concat(pages(measured), F.lit(" measured"), of)
    coverage = F.when(failed == 0, base).otherwise(F.concat(base, F.lit("; "), failed.cast("string"), F.lit(" could not be measured")))
    kind = (
        F.when(summary.isNull(), "not_recorded").when(~summary["complete"], "unavailable")
        .when((summary["chosen"] == 0) | (measured + failed == 0), "nothing_to_measure").otherwise("measured")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "measured", coverage).alias("coverage"))


def mask_selectors(text: Column) -> Column:
    """(selectors, problem) of a list written one to a line: each once, in order; too many or too long ones are a problem."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))
    problem = F.when(F.size(lines) > MAX_MASKS, "too_many").when(F.exists(lines, lambda x: F.length(x) > MAX_SELECTOR_CHARS), "too_long")
    return F.struct(lines.alias("selectors"), problem.alias("problem"))


def uncompared_reason(capture_error: Column, expired_at: Column, comparable: Column, reason: Column) -> Column:
    return (
        F.when(capture_error.isNotNull(), "could not be photographed")
        .when(expired_at.isNotNull(), "its picture has expired")
        .when(comparable.isNull(), "not compared")
        .when(~comparable, reason)
    )


def png_size(picture: Column) -> Column:
    """(width, height) from a PNG's first chunk."""
    word = lambda at: F.conv(F.hex(F.substring(picture, at, 4)), 16, 10).cast("int")
    return F.struct(word(17).alias("width"), word(21).alias("height"))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After asks for: seconds, or a date; NULL otherwise."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (F.unix_timestamp(date) - F.unix_timestamp(now)) * 1000
    return F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).cast("long") * 1000).when(date.isNotNull(), F.greatest(wait, F.lit(0)))
