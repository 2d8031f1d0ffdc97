"""Reading findings: problems with one cause, the parity grid, lists with a hidden rest, sorted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.functions import bands
from lingoscope.functions.collation import collated
from lingoscope.functions.locale import answers
from lingoscope.plans.findings import pages_involved, roles
from lingoscope.schema import GRID_ROWS


def correlate(findings: DataFrame, families: DataFrame) -> DataFrame:
    """Findings with ``problem``: those that share the pages or families they come from.

    Findings of external links only meet each other.  A finding without origin,
    or alone with its key, belongs to no problem (NULL).  Families are looked up
    under both spellings of a trailing slash; if one page has none, the pages
    themselves are the key.
    """
    rows = findings.withColumn("origin", F.array_sort(F.array_distinct(roles(F.col("type"), F.col("detail"))["origin"])))
    bare = lambda c: F.regexp_replace(c, "(?<=[^/:])/$", "")
    of = families.select("run_id", bare(F.col("url")).alias("page"), "group_key").groupBy("run_id", "page").agg(F.min("group_key").alias("group_key"))
    looked = rows.select("run_id", "ord", F.explode("origin").alias("o")).select("run_id", "ord", bare(F.col("o")).alias("page")).join(of, ["run_id", "page"], "left")
    keys = looked.groupBy("run_id", "ord").agg(F.array_sort(F.collect_set("group_key")).alias("keys"), F.bool_or(F.col("group_key").isNull()).alias("unknown"))
    rows = rows.join(keys, ["run_id", "ord"], "left")
    shape = F.when(F.size("origin") == 0, F.lit(None)).when(F.col("unknown"), "same-pages").when(F.size("keys") == 1, "one-family").otherwise("family-set")
    space = F.when(F.col("type") == "link_external_broken", "external").otherwise("site")
    key = F.when(F.size("origin") > 0, F.struct(space.alias("space"), F.when(F.col("unknown"), "pages").otherwise("families").alias("of"), F.when(F.col("unknown"), F.col("origin")).otherwise(F.col("keys")).alias("members")))
    rows = rows.withColumns({"shape": shape, "key": key})
    # findings without a key are many, and are nobody's group: each is one of its own
    size = F.count(F.lit(1)).over(Window.partitionBy("run_id", "key", F.when(F.col("key").isNull(), F.col("ord"))))
    rows = rows.withColumn("size", F.when(F.col("key").isNotNull(), size))
    shared = F.col("size") >= 2
    return rows.select("run_id", "ord", "type", "url", "detail", "origin", *(F.when(shared, F.col(x)).alias(y) for x, y in (("key", "problem"), ("shape", "shape"), ("size", "size"))))


def problems(correlated: DataFrame) -> DataFrame:
    """One row for each problem, largest first: findings, types, origin pages, place."""
    rows = correlated.where("problem is not null").groupBy("run_id", "problem", "shape").agg(
        F.array_sort(F.collect_list("ord")).alias("findings"), F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origin")))).alias("origin_pages")
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.size("findings")), "problem"))
    return rows.withColumn("place", place)


def parity_cells(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, group_key, cells, clean, gaps): a row for each family of two pages or more, a cell for each locale.

    Columns are the expected locales in their order, then what else was found.
    A cell speaks of the family's first page (by address) that answers the
    locale: present, broken, missing if expected, else not-expected.  Pages:
    (run_id, url, locale, group_key, http_status, fetch_error).  The first page of
    each locale is found before families meet the columns, so a family of any size
    is a few rows by then.
    """
    rows = pages.withColumn("broken", F.col("fetch_error").isNotNull() | F.col("http_status").isNull() | (F.col("http_status") >= 400))
    found = rows.where("locale is not null").groupBy("run_id").agg(F.array_sort(F.collect_set("locale")).alias("found"))
    columns = runs.select("run_id", "expected_locales").join(found, "run_id", "left")
    extra = F.filter(F.coalesce("found", F.array().cast("array<string>")), lambda f: ~F.exists("expected_locales", lambda e: answers(f, e)))
    columns = columns.select("run_id", F.posexplode(F.concat("expected_locales", extra)).alias("column", "locale"), F.size("expected_locales").alias("expected"))
    family = ["run_id", "group_key"]
    fams = rows.groupBy(*family).agg(F.count(F.lit(1)).alias("members")).where("members >= 2").drop("members")
    firsts = rows.where("locale is not null").groupBy(*family, F.col("locale").alias("own")).agg(F.min(F.struct("url", "locale", "broken")).alias("first"))
    fit = firsts.join(columns.select("run_id", "column", "locale"), "run_id").where(answers(F.col("own"), F.col("locale")))
    first = fit.groupBy(*family, "column").agg(F.min("first").alias("first"))
    cell = F.when(F.col("first").isNotNull(), F.when(F.col("first.broken"), "broken").otherwise("present")).when(F.col("column") < F.col("expected"), "missing").otherwise("not-expected")
    cells = fams.join(columns, "run_id").join(first, [*family, "column"], "left").withColumn("cell", cell).groupBy(*family).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column", "cell"))), lambda x: x["cell"]).alias("cells")
    )
    clean = F.forall("cells", lambda x: x.isin("present", "not-expected"))
    gaps = F.size(F.filter("cells", lambda x: x.isin("missing", "broken")))
    return cells.withColumns({"clean": clean, "gaps": gaps})


def parity(pages: DataFrame, runs: DataFrame, max_rows: int = GRID_ROWS) -> DataFrame:
    """(run_id, place, group_key, cells, clean, gaps, hidden): the families with gaps (see parity_cells), those with most first."""
    cells = parity_cells(pages, runs)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("clean", F.desc("gaps"), "group_key"))
    shown = cells.where("not clean")
    total = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return shown.withColumns({"place": place, "hidden": F.greatest(total - max_rows, F.lit(0))}).where(F.col("place") <= max_rows)


def parity_listed(pages: DataFrame, runs: DataFrame, max_rows: int = GRID_ROWS) -> DataFrame:
    """(run_id, place, group_key, cells, hidden, clean, singles): all families, those with a problem first, then by name.

    ``hidden`` is how many a run has beyond those shown, ``clean`` how many have no
    problem, ``singles`` how many pages have no other version.  Totals are sums, so
    that only the first rows of each task take part in a run's order.
    """
    cells = parity_cells(pages, runs)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("clean", *collated("group_key")))
    shown = cells.withColumn("place", place).where(F.col("place") <= max(1, max_rows)).select("run_id", "place", "group_key", "cells")
    totals = cells.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("clean").alias("clean"))
    singles = pages.groupBy("run_id", "group_key").agg(F.count(F.lit(1)).alias("members")).groupBy("run_id").agg(F.count_if(F.col("members") == 1).alias("singles"))
    hidden = F.greatest(F.col("n") - max(1, max_rows), F.lit(0)).alias("hidden")
    return shown.join(totals, "run_id").join(singles, "run_id").select("run_id", "place", "group_key", "cells", hidden, "clean", "singles")


def with_hidden(df: DataFrame, by: list[str], order: list, shown: int) -> DataFrame:
    """The first rows of each group in an order, with how many are hidden."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumns({"place": place, "hidden": F.greatest(total - shown, F.lit(0))}).where(F.col("place") <= shown)


def listed(items: Column, limit: int = 5) -> Column:
    """(shown, hidden) of a list."""
    return F.struct(F.slice(items, 1, max(1, limit)).alias("shown"), F.greatest(F.size(items) - max(1, limit), F.lit(0)).alias("hidden"))


def by_type(findings: DataFrame) -> DataFrame:
    """(run_id, type, findings, pages, first): counts of findings and of the pages they touch, in order of appearance."""
    rows = findings.withColumn("pages", pages_involved(roles(F.col("type"), F.col("detail"))))
    touched = rows.select("run_id", "type", F.explode_outer("pages").alias("page")).groupBy("run_id", "type").agg(F.count_distinct("page").alias("pages"))
    return rows.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("findings"), F.min("ord").alias("first")).join(touched, ["run_id", "type"])


def observations_order() -> list[Column]:
    """Failed ones first, then most errors, then slowest; not measured counts as fastest."""
    return [F.col("render_error").isNull(), F.desc("first_party_errors"), F.desc(F.coalesce("lcp_ms", F.lit(-1))), *collated("url")]


def observations_in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*observations_order())


def snapshots_order(last: list[Column] | None = None) -> list[Column]:
    """Pictures that couldn't be compared first, then most changed, then by address (or ``last``); what is below the floor hasn't changed."""
    compared = F.col("comparable"), F.col("changed_pixels"), F.col("compared_pixels")
    refused = bands.uncompared_reason(F.col("capture_error"), F.col("expired_at"), F.col("comparable"), F.col("reason")).isNotNull()
    return [F.desc(refused), F.desc(F.when(bands.differs(*compared), bands.change_share(*compared)).otherwise(F.lit(-1.0))), *(last or collated("url"))]


def spread(correlated: DataFrame, statuses: DataFrame) -> DataFrame:
    """(run_id, problem, findings, new, sentence): how many findings of each problem are new since the run before.

    The sentence is NULL if none is, or all are.  Correlated findings as ``correlate``
    gives them, statuses (run_id, ord, status) as ``runs.compare_runs`` does.
    """
    rows = correlated.where("problem is not null").join(statuses.where("status <> 'resolved'").select("run_id", "ord", "status"), ["run_id", "ord"], "left")
    rows = rows.groupBy("run_id", "problem").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "new").alias("new"))
    sentence = F.concat(F.col("new").cast("string"), F.lit(" of "), F.col("findings").cast("string"), F.lit(" new since the previous run"))
    return rows.withColumn("sentence", F.when((F.col("new") > 0) & (F.col("new") < F.col("findings")), sentence))
