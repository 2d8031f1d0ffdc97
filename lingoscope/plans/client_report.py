"""A finished run as a document for those whose site it is: what was covered, found, looks different and is gone.

Every part is a table of lines, keyed by run, so one plan writes the documents of
any number of runs.  Nothing is cut short: a list that is too long to print is
left out as a whole, and a sentence says so and how long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions import bands, sentences
from lingoscope.operators.storage import parts_for
from lingoscope.plans import reports
from lingoscope.plans.findings import pages_involved, roles
from lingoscope.schema import MAX_LISTED_PAGES, MAX_UNBROKEN_PAGES

#: The sentences of the document itself.
NOTHING_FOUND = "Nothing was found by the checks that ran on this pass."
COMPARED = "Compared against the reference pictures set for this site."
SUPERSEDED = (
    "Compared against the reference pictures that were set for this site at the time of this check. Those reference pictures have since been replaced, "
    "so the earlier version shown below may not be the one this check compared against."
)
WITHHELD = " pages are affected — too many to list in a printed report. Your developer can see the full list in the check itself."
#: The parts in their order.
HEAD, COVERED, FOUND, DIFFERENT, GONE = range(5)


def reportable(runs: DataFrame) -> DataFrame:
    """Runs that have ended: of one still going only its progress could be told."""
    return runs.where(F.col("status").isNotNull() & ~F.col("status").isin("queued", "running"))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def _heading(kind: Column) -> Column:
    return F.coalesce(sentences.client_label(kind), F.lit(sentences.CLIENT_UNKNOWN_LABEL))


def _kinds(findings: DataFrame) -> DataFrame:
    """(run_id, type, instances, place): the kinds of a run in order of their first finding; at most one row a rule."""
    counts = findings.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("instances"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first", "type"))
    return counts.select("run_id", "type", "instances", place.alias("place"))


def found(findings: DataFrame, parts: int | None = None) -> DataFrame:
    """(run_id, place, ord, type, heading, instances, sentence, pages, withheld, unbroken) of each finding.

    Kinds keep the order in which the run recorded them, and so do findings of a
    kind (``ord``).  ``pages`` is NULL above MAX_LISTED_PAGES, where ``withheld``
    speaks instead; up to MAX_UNBROKEN_PAGES a finding fits one sheet.  Findings
    meet their kinds in ``parts`` tasks (see ``lines``).
    """
    parts = parts or parts_for(findings)
    involved = F.array_distinct(pages_involved(roles(F.col("type"), F.col("detail"))))
    both = ["run_id", "type"]
    rows = findings.repartition(parts, *both).withColumn("involved", involved).withColumn("n", F.size("involved"))
    rows = rows.join(_kinds(findings).repartition(parts, *both), both)
    fits = F.col("n") <= MAX_LISTED_PAGES
    return rows.select(
        "run_id", "place", "ord", "type", _heading(F.col("type")).alias("heading"), _counted(F.col("instances"), "instance", "instances").alias("instances"),
        sentences.client_sentence(F.col("type"), F.col("detail")).alias("sentence"), F.when(fits, F.col("involved")).alias("pages"),
        F.when(~fits, F.concat(F.col("n").cast("string"), F.lit(WITHHELD))).alias("withheld"), (F.col("n") <= MAX_UNBROKEN_PAGES).alias("unbroken"),
    )


def gone(compared: DataFrame) -> DataFrame:
    """(run_id, place, heading, instances): kinds that the run before reported and this one didn't find (see runs.compare_runs)."""
    kinds = _kinds(compared.where("status = 'resolved'"))
    return kinds.select("run_id", "place", _heading(F.col("type")).alias("heading"), F.when(F.col("instances") > 1, F.concat(F.col("instances").cast("string"), F.lit(" instances"))).alias("instances"))


def different(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, nth, url, note): pages whose pictures changed and are still held, most changed first.

    ``note`` says whether the project's reference pictures were replaced since.  A
    run watches few pages, so one order for each run stays small.
    """
    compared = F.col("comparable"), F.col("changed_pixels"), F.col("compared_pixels")
    refused = bands.uncompared_reason(F.col("capture_error"), F.col("expired_at"), F.col("comparable"), F.col("reason")).isNotNull()
    rows = snapshots.where(~refused & bands.differs(*compared))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(*reports.snapshots_order()))
    replaced = F.col("visual_summary").isNotNull() & ~F.col("visual_summary.baseline_run_id").eqNullSafe(F.col("project_baseline"))
    notes = runs.select("run_id", F.when(replaced, SUPERSEDED).otherwise(COMPARED).alias("note"))
    return rows.select("run_id", "url", nth.alias("nth")).join(notes, "run_id").select("run_id", "nth", "url", "note")


def covered(runs: DataFrame) -> DataFrame:
    """(run_id, name, start_url, checked, sentences): the head of the document and what the run covered."""
    pictures = F.col("visual_summary")
    told = sentences.client_coverage_sentences(
        bands.crawl_coverage(F.col("crawl_complete"), F.col("page_limit")), bands.scope_coverage(F.col("scope")), bands.rules_coverage(F.col("rule_set"))["kind"],
        bands.picture_coverage(pictures), pictures["compared"], F.col("pages_crawled"),
    )
    day = F.date_format(F.coalesce("started_at", "created_at"), "d MMMM yyyy")
    checked = F.concat(F.lit("Checked "), day, F.lit(" · "), _counted(F.col("pages_crawled"), "page", "pages"), F.lit(" looked at"))
    return runs.select("run_id", "name", "start_url", checked.alias("checked"), told.alias("sentences"))


def lines(runs: DataFrame, findings: DataFrame, compared: DataFrame, snapshots: DataFrame, parts: int | None = None) -> DataFrame:
    """(run_id, part, place, nth, heading, line, note, pages): the documents of all ended runs, a row for each line.

    Lines are read by (part, place, nth).  Runs: (run_id, name, start_url, status,
    created_at, started_at, pages_crawled, crawl_complete, page_limit, scope,
    rule_set, visual_summary, project_baseline).  Findings, comparisons and
    snapshots of other runs are left out.

    All tables are worked on in ``parts`` tasks by run, so that none grows with them.
    With ``parts`` they have been dealt so (``repartition(parts, "run_id")``) by the
    caller; without, their rows are counted and dealt here.
    """
    if parts is None:
        parts = parts_for(runs, findings, compared, snapshots)
        runs, findings, compared, snapshots = (t.repartition(parts, "run_id") for t in (runs, findings, compared, snapshots))
    ended = reportable(runs)
    keys = ended.select("run_id")
    held = lambda df: df.join(keys, "run_id", "left_semi")
    none = F.lit(None).cast("string")
    no_pages = F.lit(None).cast("array<string>")

    def part(df: DataFrame, at: int, place, nth, heading, line, note=none, pages=no_pages) -> DataFrame:
        return df.select(
            "run_id", F.lit(at).alias("part"), place.cast("long").alias("place"), nth.cast("long").alias("nth"), heading.alias("heading"), line.alias("line"), note.alias("note"), pages.alias("pages")
        )

    zero = F.lit(0)
    about = covered(ended)
    findings = held(findings)
    head = part(about, HEAD, zero, zero, F.col("name"), F.col("checked"), F.col("start_url"))
    told = part(about.select("run_id", F.posexplode("sentences").alias("at", "sentence")), COVERED, F.col("at"), zero, none, F.col("sentence"))
    seen = found(findings, parts)
    list_ = part(seen, FOUND, F.col("place"), F.col("ord"), F.col("heading"), F.col("sentence"), F.coalesce("withheld", "instances"), F.col("pages"))
    empty = part(keys.join(findings.select("run_id").distinct(), "run_id", "left_anti"), FOUND, zero, zero, none, F.lit(NOTHING_FOUND))
    changed = different(held(snapshots), ended)
    pictures = part(changed, DIFFERENT, F.col("nth"), zero, none, F.col("url"), F.col("note"))
    resolved = part(gone(held(compared)), GONE, F.col("place"), zero, none, F.col("heading"), F.col("instances"))
    out = head
    for df in (told, list_, empty, pictures, resolved):
        out = out.unionByName(df)
    return out
