"""Runs over time: comparability, comparison, trend, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions.collation import collated
from lingoscope.plans.findings import identity
from lingoscope.schema import GRID_ROWS, SNAPSHOTS_KEPT, TREND_RUNS


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def comparability(previous: Column, current: Column) -> Column:
    """Why two runs (structs of crawl_complete, scope, rule_set) can't be compared; NULL if they can."""
    both = (previous, current)
    missing = F.lit(False)
    partial = F.lit(False)
    for r in both:
        missing = missing | r["crawl_complete"].isNull() | r["scope"].isNull() | r["rule_set"].isNull()
        partial = partial | ~r["crawl_complete"]
    parts = [~same_set(previous["scope"][f], current["scope"][f]) for f in ("include_paths", "exclude_paths", "locales")]
    return (
        F.when(missing, "not_recorded")
        .when(partial, "incomplete_crawl")
        .when(parts[0] | parts[1] | parts[2], "scope_changed")
        .when(~same_set(previous["rule_set"], current["rule_set"]), "rules_changed")
    )


def visual_comparability(previous: Column, current: Column) -> Column:
    """The same for picture passes (structs of complete, baseline_run_id)."""
    return (
        F.when(previous.isNull() | current.isNull(), "not_recorded")
        .when(~previous["complete"] | ~current["complete"], "incomplete_crawl")
        .when(~previous["baseline_run_id"].eqNullSafe(current["baseline_run_id"]), "baseline_changed")
    )


def with_predecessor(runs: DataFrame) -> DataFrame:
    """Runs with ``previous``, the project's newest earlier run whatever its state, and ``reason``."""
    facts = F.struct("run_id", "crawl_complete", "scope", "rule_set")
    rows = runs.withColumn("previous", F.lag(facts).over(Window.partitionBy("project_id").orderBy("created_at", "run_id")))
    return rows.withColumn("reason", F.when(F.col("previous").isNull(), "no_predecessor").otherwise(comparability(F.col("previous"), facts)))


def compare(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Matches two multisets of findings (keys, identity, id): new, still_present or resolved.

    The n-th finding of an identity meets the n-th of the other side, by id.
    """
    order = Window.partitionBy(*keys, "identity").orderBy("id")
    old = previous.select(*keys, "identity", F.col("id").alias("previous_id"), F.row_number().over(order).alias("nth"))
    new = current.select(*keys, "identity", "id", F.row_number().over(order).alias("nth"))
    both = new.join(old, [*keys, "identity", "nth"], "full")
    return both.withColumn("status", F.when(F.col("previous_id").isNull(), "new").when(F.col("id").isNull(), "resolved").otherwise("still_present"))


def compare_runs(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Every run's findings against its predecessor's: (run_id, ord, type, url, status, reason).

    ``status`` is NULL, and nothing is called resolved, where runs can't be compared.
    """
    named = findings.withColumn("identity", identity(F.col("type"), F.col("detail"), F.col("url")))
    pairs = with_predecessor(runs).select("run_id", F.col("previous.run_id").alias("before"), "reason")
    current = named.join(pairs, "run_id").select("run_id", "reason", "identity", "type", "url", F.col("ord").alias("id"))
    earlier = named.withColumnRenamed("run_id", "before").join(pairs.where("reason is null"), "before").select("run_id", "identity", "type", "url", F.col("ord").alias("id"))
    matched = compare(earlier, current.where("reason is null"), ["run_id"])
    now = current.join(matched.select("run_id", "id", "status").where("id is not null"), ["run_id", "id"], "left").select("run_id", F.col("id").alias("ord"), "type", "url", "status", "reason")
    gone = matched.where("status = 'resolved'").select("run_id", F.col("previous_id").alias("id"), "identity").join(earlier, ["run_id", "id", "identity"])
    return now.unionByName(gone.select("run_id", F.col("id").alias("ord"), "type", "url", F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("reason")))


def trend_runs(runs: DataFrame, limit: int = TREND_RUNS) -> DataFrame:
    """Of each project's newest runs, those that compare with the newest sound one; ``column`` counts from the oldest."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    facts = F.struct("run_id", "crawl_complete", "scope", "rule_set")
    rows = runs.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit).withColumn("facts", facts)
    sound = F.when(comparability(F.col("facts"), F.col("facts")).isNull(), F.col("nth"))
    reference = rows.withColumn("sound", sound).where("sound is not null").groupBy("project_id").agg(F.min_by("facts", "sound").alias("reference"))
    reason = comparability(F.col("facts"), F.col("reference"))
    # a run with other rules still takes part: what it didn't check is shown as such
    fit = rows.join(reference, "project_id").where(reason.isNull() | (reason == "rules_changed"))
    return fit.withColumn("column", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "run_id"))).drop("nth", "facts", "reference")


def trend(runs: DataFrame, findings: DataFrame, max_rows: int = GRID_ROWS) -> DataFrame:
    """(project_id, place, type, cells, moved, found, hidden): a row for each rule, a cell for each run.

    A cell is a count only if the run's rules had the type; zero then means none
    were found.  Rows that moved come first, then those that found anything, then by name.
    """
    fit = trend_runs(runs).select("project_id", "run_id", "column", "rule_set")
    counts = findings.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"))
    types = fit.select("project_id", F.explode("rule_set").alias("type")).union(fit.join(counts, "run_id").select("project_id", "type")).distinct()
    grid = types.join(fit, "project_id").join(counts, ["run_id", "type"], "left")
    cell = F.when(F.array_contains("rule_set", F.col("type")), F.coalesce("n", F.lit(0)))
    rows = grid.withColumn("cell", cell).groupBy("project_id", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column", "cell"))), lambda x: x["cell"]).alias("cells"), F.sum("cell").alias("found"), (F.min("cell") != F.max("cell")).alias("moved")
    )
    rows = rows.withColumns({"found": F.coalesce("found", F.lit(0)), "moved": F.coalesce("moved", F.lit(False))})
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("moved"), F.desc(F.col("found") > 0), *collated("type")))
    total = F.count(F.lit(1)).over(Window.partitionBy("project_id"))
    return rows.withColumns({"place": place, "hidden": F.greatest(total - max_rows, F.lit(0))}).where(F.col("place") <= max_rows)


def runs_to_expire(runs: DataFrame, kept: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Runs (project_id, run_id, created_at, is_baseline) whose pictures go: all but the newest few and the baseline."""
    order = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.where("not is_baseline").withColumn("nth", F.row_number().over(order)).where(F.col("nth") > kept).drop("nth")


def expired(snapshots: DataFrame, runs: DataFrame, now: Column, kept: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Snapshots with the pictures of expired runs taken out and stamped."""
    gone = runs_to_expire(runs, kept).select("run_id", F.lit(True).alias("gone"))
    rows = snapshots.join(gone, "run_id", "left")
    drop = F.col("gone") & F.col("picture").isNotNull()
    return rows.withColumns({"expired_at": F.when(drop, now).otherwise(F.col("expired_at")), "picture": F.when(F.col("gone"), F.lit(None)).otherwise(F.col("picture"))}).drop("gone")


def comparison_state(has_predecessor: Column, reason: Column) -> Column:
    """Whether a run's comparison is shown: none, refused or compared."""
    return F.when(~has_predecessor, "none").when(reason.isNotNull(), "refused").otherwise("compared")


def swept(runs: DataFrame) -> DataFrame:
    """Runs with those that a stopped service left queued or running as interrupted."""
    return runs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def with_page_ids(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with the ``page_id`` of their address in the run; NULL where the run has no such page."""
    return findings.join(pages.select("run_id", "url", "page_id"), ["run_id", "url"], "left")


def recorded_observations(observations: DataFrame, pages: DataFrame) -> DataFrame:
    """Observations by page, times in whole milliseconds; addresses that the run has no page for are left out."""
    rows = observations.join(pages.select("run_id", "url", "page_id"), ["run_id", "url"])
    return rows.withColumns({c: F.round(c).cast("int") for c in ("ttfb_ms", "lcp_ms")}).withColumn("cls", F.col("cls").cast("string"))


def recorded_snapshots(snapshots: DataFrame, pages: DataFrame, runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Snapshots with their page's ``url``, what their run compared with and what their project's baseline is today.

    Pictures themselves are left out, and so are snapshots whose page the run hasn't
    recorded.  Runs: (run_id, project_id, visual_summary, pages_crawled), projects:
    (project_id, baseline_run_id, mask_selectors); without masks the list is empty.
    """
    told = projects.select("project_id", F.col("baseline_run_id").alias("project_baseline"), F.coalesce("mask_selectors", F.array().cast("array<string>")).alias("mask_selectors"))
    about = runs.select("run_id", "project_id", "visual_summary", "pages_crawled").join(told, "project_id", "left").drop("project_id")
    return snapshots.drop("picture").join(pages.select("run_id", "page_id", "url"), ["run_id", "page_id"]).join(about, "run_id")


def recorded_pages(pages: DataFrame, run: Column) -> DataFrame:
    """The pages of one run in the order of their addresses."""
    return pages.where(F.col("run_id") == run).orderBy(*collated("url"))


def added(held: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` and those rows of ``more`` whose keys it lacks; one row for a key."""
    return held.unionByName(more.join(held, keys, "left_anti").dropDuplicates(keys))


def visible_projects(projects: DataFrame, assignments: DataFrame, tenant: Column, user: Column, owner: Column) -> DataFrame:
    """Projects of a tenant that aren't archived and that the user is assigned to; an owner sees all."""
    rows = projects.where((F.col("tenant_id") == tenant) & F.col("archived_at").isNull())
    assigned = assignments.where(F.col("user_id") == user).select("project_id").distinct().withColumn("assigned", F.lit(True))
    return rows.join(assigned, "project_id", "left").where(owner | F.col("assigned")).drop("assigned")
