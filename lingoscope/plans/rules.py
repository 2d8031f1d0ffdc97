"""The detection rules, each a join, anti-join or grouping over one or many crawls.

A rule takes a ``Crawl`` and returns (run_id, type, url, detail).  All are keyed
by run, so one plan judges any number of runs.  A rule says nothing where a fact
wasn't recorded; those marked *whole* also say nothing unless the crawl was.
Some rules defer to others: the sets they defer to are parts of their plans.

Tables that several rules read (judged pages, families, declarations, links and
the sets that rules defer to) are written once for a crawl; rules then read the
few columns they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingoscope import schema as S
from lingoscope.functions import bands, headers
from lingoscope.functions.locale import answers, is_language_tag, locale_from_path, primary
from lingoscope.functions.urls import ancestors, in_scope, origin_of, page_url, path_of
from lingoscope.operators.storage import stored
from lingoscope.plans.variants import declarations, families
from lingoscope.sources.robots import group_for, verdicts
from lingoscope.sources.sitemap import reconciled


def is_failed(error: Column, status: Column) -> Column:
    return error.isNotNull() | status.isNull() | (status >= 400)


def conforming(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the schema's columns that it lacks, as NULLs: not recorded."""
    kinds = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], schema).schema}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in df.columns})


FILE_ROWS = 20_000  # of a crawl's tables: its pages are much alike, and each gives many rows


def kept(df: DataFrame) -> DataFrame:
    return stored(df, FILE_ROWS)


def once(part):
    """For a part of the plans that several rules read: written at its first use."""

    @wraps(part)
    def run(c: Crawl) -> DataFrame:
        if part.__name__ not in c.kept:
            c.kept[part.__name__] = kept(part(c))
        return c.kept[part.__name__]

    return run


@dataclass
class Crawl:
    """What crawls recorded; tables and columns that are left out weren't recorded."""

    spark: SparkSession
    pages: DataFrame
    runs: DataFrame
    reverified: DataFrame | None = None
    aliases: DataFrame | None = None
    external: DataFrame | None = None
    image_weights: DataFrame | None = None
    sitemap: DataFrame | None = None
    robots: DataFrame | None = None
    certificates: DataFrame | None = None
    observations: DataFrame | None = None
    visual: DataFrame | None = None
    kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.pages, self.runs = conforming(self.pages, S.PAGES), conforming(self.runs, S.RUNS)
        for name, kind in (
            ("reverified", S.REVERIFIED), ("aliases", S.ALIASES), ("external", S.EXTERNAL), ("image_weights", S.IMAGE_WEIGHTS), ("sitemap", S.SITEMAP),
            ("robots", S.ROBOTS), ("certificates", S.CERTIFICATES), ("observations", S.OBSERVATIONS), ("visual", S.VISUAL),
        ):
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], kind))

    def written(self) -> list[DataFrame]:
        """The tables that this crawl has in the shared folder by now."""
        return [t for t in (*vars(self).values(), *self.kept.values()) if isinstance(t, DataFrame) and hasattr(t, "_stored_at")]

    @cached_property
    def recorded(self) -> DataFrame:
        """The pages, read from their HTML once at most."""
        return kept(self.pages.select(*self.spark.createDataFrame([], S.PAGES).columns))

    @cached_property
    def judged(self) -> DataFrame:
        """Pages with the status that holds (a second observation replaces the first) and run facts."""
        again = self.reverified.select("run_id", "url", F.col("http_status").alias("s2"), F.col("fetch_error").alias("e2"), F.col("confirmed").alias("confirmed"), F.lit(True).alias("again"))
        rows = self.recorded.join(again, ["run_id", "url"], "left")
        rows = rows.withColumns(
            {"http_status": F.when(F.col("again"), F.col("s2")).otherwise(F.col("http_status")), "fetch_error": F.when(F.col("again"), F.col("e2")).otherwise(F.col("fetch_error"))}
        ).drop("s2", "e2", "again")
        rows = rows.withColumn("failed", is_failed(F.col("fetch_error"), F.col("http_status")))
        facts = self.runs.select("run_id", "base", F.coalesce("crawl_complete", F.lit(False)).alias("whole"), "include_paths", "exclude_paths")
        return kept(rows.join(facts, "run_id").withColumn("html_page", ~F.col("failed") & F.coalesce(F.col("content.is_html"), F.lit(False))))

    @cached_property
    def family(self) -> DataFrame:
        return kept(families(self.recorded))

    @cached_property
    def members(self) -> DataFrame:
        """Pages of families of two or more, with their family and locale."""
        rows = self.family.join(self.judged.select("run_id", "url", "failed", "html_page", "whole", "content", "http_status", "fetch_error", "hreflang"), ["run_id", "url"])
        big = rows.groupBy("run_id", "group_key").agg(F.count(F.lit(1)).alias("size")).where("size >= 2").drop("size")
        return kept(rows.join(big, ["run_id", "group_key"]))

    @cached_property
    def declared(self) -> DataFrame:
        """(run_id, declared_by, locale, target): alternates in a named language, to other pages."""
        rows = declarations(self.recorded).where(is_language_tag(F.col("locale")) & (F.col("url") != F.col("target")))
        return kept(rows.withColumnRenamed("url", "declared_by"))

    @cached_property
    def links(self) -> DataFrame:
        """(run_id, src, dst): every link to another address, once."""
        return kept(self.recorded.select("run_id", F.col("url").alias("src"), F.explode("links").alias("dst")).where("src <> dst").distinct())

    @cached_property
    def comparable_entries(self) -> DataFrame:
        """(run_id, url, raw): sitemap entries that the run could have crawled, once."""
        rows = reconciled(self.sitemap, self.runs).where("part = 'comparable'")
        return kept(rows.groupBy("run_id", "url").agg(F.min("raw").alias("raw")))

    def scoped(self, df: DataFrame, url: str) -> DataFrame:
        """Rows whose address the run meant to crawl."""
        facts = self.runs.select("run_id", "base", "include_paths", "exclude_paths")
        here = (origin_of(F.col(url)) == origin_of(F.col("base"))) & in_scope(path_of(F.col(url)), F.col("include_paths"), F.col("exclude_paths"))
        return df.join(facts, "run_id").where(here).drop("base", "include_paths", "exclude_paths")

    def whole_only(self, df: DataFrame) -> DataFrame:
        return df.join(self.runs.where("crawl_complete").select("run_id"), "run_id", "left_semi")


def _finding(df: DataFrame, kind: str, url: Column | None, /, **detail) -> DataFrame:
    fields = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in detail.items()]
    return df.select("run_id", F.lit(kind).alias("type"), (F.lit(None).cast("string") if url is None else url).alias("url"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("detail"))


def _sorted_set(column: str | Column) -> Column:
    return F.array_sort(F.collect_set(column))


# ---------------------------------------------------------------- language variants


def missing_locale(c: Crawl) -> DataFrame:
    """*Whole.*  A family that no member of answers an expected locale."""
    fam = c.members.groupBy("run_id", "group_key").agg(
        _sorted_set("locale").alias("present"), _sorted_set("url").alias("urls"), F.bool_and("failed").alias("all_failed"), F.first("whole").alias("whole")
    )
    fam = fam.where("whole and not all_failed and size(present) > 0").join(c.runs.select("run_id", F.explode("expected_locales").alias("expected")), "run_id")
    fam = fam.where(~F.exists("present", lambda p: answers(p, F.col("expected"))))
    return _finding(fam, "missing_locale", F.get("urls", F.lit(0)), groupKey="group_key", missingLocale="expected", presentLocales="present", memberUrls="urls")


@once
def _diverged(c: Crawl) -> DataFrame:
    broken = c.members.where("failed").select("run_id", "group_key", F.col("url").alias("target"), "locale", "http_status", "fetch_error")
    by = c.declared.groupBy("run_id", "target").agg(_sorted_set("declared_by").alias("by")).where("size(by) >= 2")
    healthy = c.members.where("not failed").groupBy("run_id", "group_key").agg(_sorted_set("url").alias("healthy"))
    return broken.join(by, ["run_id", "target"]).join(healthy, ["run_id", "group_key"])


def variant_diverged(c: Crawl) -> DataFrame:
    """A broken member that two or more pages declare while a sibling works."""
    return _finding(
        _diverged(c), "variant_diverged", None,
        groupKey="group_key", brokenUrl="target", locale="locale", httpStatus="http_status", fetchError="fetch_error", declaredBy="by", healthyUrls="healthy",
    )


def hreflang_target_failed(c: Crawl) -> DataFrame:
    """A declared alternate that failed, unless variant_diverged speaks for it."""
    bad = c.judged.where("failed").select("run_id", F.col("url").alias("target"), "http_status", "fetch_error")
    rows = c.declared.join(bad, ["run_id", "target"]).join(_diverged(c).select("run_id", "target"), ["run_id", "target"], "left_anti")
    return _finding(rows, "hreflang_target_failed", F.col("declared_by"), declaredBy="declared_by", locale="locale", target="target", httpStatus="http_status", fetchError="fetch_error")


def hreflang_target_unreached(c: Crawl) -> DataFrame:
    """*Whole.*  A declared alternate inside the scope that the crawl never recorded."""
    known = c.recorded.select("run_id", F.col("url").alias("target"))
    rows = c.whole_only(c.scoped(c.declared.join(known, ["run_id", "target"], "left_anti"), "target"))
    return _finding(rows, "hreflang_target_unreached", F.col("declared_by"), declaredBy="declared_by", locale="locale", target="target")


@once
def _inconsistent(c: Crawl) -> DataFrame:
    own = F.filter(F.map_entries(F.coalesce("hreflang", F.create_map().cast("map<string,string>"))), lambda e: is_language_tag(e["key"]))
    healthy = c.members.where("not failed").withColumn("own", own)
    # members that neither declare nor are declared in a language have no place in the comparison
    taking = healthy.where(F.col("locale").isNotNull() & ((F.size("own") > 0) | F.col("group_key").isNotNull()))
    family = ["run_id", "group_key"]
    # read four times below
    page = kept(taking.select(*family, "url", "locale", "own", F.transform("own", lambda e: primary(e["key"])).alias("languages"), primary(F.col("locale")).alias("language")))
    other = page.select(*family, F.col("url").alias("sibling"), F.col("locale").alias("sibling_locale"), F.col("language").alias("sibling_language"), F.col("own").alias("sibling_own"))
    defect = lambda kind: F.struct("url", F.lit(kind).alias("kind"), "sibling", F.col("sibling_locale").alias("siblingLocale"), F.lit(None).cast("string").alias("locale")).alias("defect")
    # siblings that name a page which doesn't declare their language: by what they declare
    naming = other.select("*", F.explode(F.array_distinct(F.transform("sibling_own", lambda e: e["value"]))).alias("url")).drop("sibling_own").where("url <> sibling")
    named = page.join(naming, [*family, "url"]).where((F.col("language") != F.col("sibling_language")) & ~F.array_contains("languages", F.col("sibling_language")))
    # languages that a family has and a page that declares some lacks: only siblings in these are met
    spoken = page.groupBy(*family).agg(F.collect_set("language").alias("spoken"))
    lacks = page.where(F.size("own") > 0).join(spoken, family).withColumn("sibling_language", F.explode(F.array_except("spoken", F.array_append("languages", F.col("language")))))
    met = lacks.join(other, [*family, "sibling_language"]).where((F.col("url") != F.col("sibling")) & ~F.exists("sibling_own", lambda e: e["value"] == F.col("url")))
    lacking = named.select(*family, defect("not_reciprocated")).unionByName(met.select(*family, defect("incomplete")))
    silent = page.where((F.size("own") > 0) & ~F.array_contains("languages", F.col("language")))
    selfless = silent.select("run_id", "group_key", F.struct("url", F.lit("no_self_reference").alias("kind"), F.lit(None).cast("string").alias("sibling"), F.lit(None).cast("string").alias("siblingLocale"), "locale").alias("defect"))
    return lacking.unionByName(selfless).groupBy("run_id", "group_key").agg(F.array_sort(F.collect_set("defect")).alias("defects"))


def hreflang_family_inconsistent(c: Crawl) -> DataFrame:
    """A family whose healthy members' declarations disagree, by language; one finding each."""
    urls = c.members.groupBy("run_id", "group_key").agg(_sorted_set("url").alias("urls"))
    return _finding(_inconsistent(c).join(urls, ["run_id", "group_key"]), "hreflang_family_inconsistent", None, groupKey="group_key", memberUrls="urls", defects="defects")


def no_hreflang(c: Crawl) -> DataFrame:
    """A path that implies a locale on a page that declares no other page, outside described families."""
    implied = locale_from_path(path_of(F.col("url")))
    others = F.filter(F.map_values(F.coalesce("hreflang", F.create_map().cast("map<string,string>"))), lambda t: t != F.col("url"))
    rows = c.judged.where("html_page").where(F.size(others) == 0).withColumn("implied", implied).where("implied is not null")
    described = c.members.join(_inconsistent(c).select("run_id", "group_key"), ["run_id", "group_key"], "left_semi").select("run_id", "url")
    return _finding(rows.join(described, ["run_id", "url"], "left_anti"), "no_hreflang", F.col("url"), url="url", impliedLocale="implied")


@once
def _identical(c: Crawl) -> DataFrame:
    rows = c.members.where("whole and html_page and content.text_digest is not null and locale is not null")
    return rows.groupBy("run_id", "group_key", F.col("content.text_digest").alias("digest")).agg(
        _sorted_set("url").alias("urls"), _sorted_set("locale").alias("locales"), F.count_distinct(primary(F.col("locale"))).alias("languages")
    ).where("languages >= 2")


def content_untranslated(c: Crawl) -> DataFrame:
    """Placeholders left in a page; *whole:* one text served in two languages of a family."""
    rows = c.judged.where("html_page and size(content.markers) > 0").join(c.family.select("run_id", "url", "locale"), ["run_id", "url"])
    left = _finding(rows, "content_untranslated", F.col("url"), kind=F.lit("placeholder_markers"), url="url", locale="locale", markers=F.col("content.markers"))
    same = _finding(_identical(c), "content_untranslated", None, kind=F.lit("identical_to_siblings"), groupKey="group_key", urls="urls", locales="locales")
    return left.unionByName(same)


def content_structure_differs(c: Crawl) -> DataFrame:
    """*Whole.*  Healthy isolated members of a family that disagree on a kind of block."""
    rows = c.members.where("whole and html_page and content.isolated").select("run_id", "group_key", "url", "content.blocks.*")
    some = [(F.bool_or(b) & ~F.bool_and(b)).alias(f"{b}_differs") for b in S.BLOCKS]
    fam = rows.groupBy("run_id", "group_key").agg(F.array_sort(F.collect_list(F.struct("url", *S.BLOCKS))).alias("pages"), *some)
    fam = fam.where(" or ".join(f"{b}_differs" for b in S.BLOCKS))

    def difference(block: str) -> Column:
        with_it, without = (F.transform(F.filter("pages", test), lambda p: p["url"]) for test in (lambda p: p[block], lambda p: ~p[block]))
        return F.when(F.col(f"{block}_differs"), F.struct(F.lit(block).alias("block"), with_it.alias("present"), without.alias("absent")))

    urls = F.array_distinct(F.transform("pages", lambda p: p["url"]))
    return _finding(fam, "content_structure_differs", None, groupKey="group_key", memberUrls=urls, differences=F.array_compact(F.array(*map(difference, S.BLOCKS))))


# ---------------------------------------------------------------- metadata


def metadata_missing(c: Crawl) -> DataFrame:
    """A page without title or description."""
    fields = F.array_compact(F.array(F.when(F.col("metadata.title").isNull(), F.lit("title")), F.when(F.col("metadata.description").isNull(), F.lit("description"))))
    return _finding(c.judged.where("html_page").withColumn("fields", fields).where("size(fields) > 0"), "metadata_missing", F.col("url"), url="url", fields="fields")


def metadata_duplicated(c: Crawl) -> DataFrame:
    """*Whole.*  One title or description on several pages of a language; no language is one of its own."""
    rows = c.judged.where("whole and html_page").join(c.family.select("run_id", "url", "locale"), ["run_id", "url"])
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"metadata.{f}").alias("value")) for f in ("title", "description")))).alias("f")
    rows = rows.select("run_id", "url", primary(F.col("locale")).alias("language"), fields).where("f.value is not null")
    same = rows.groupBy("run_id", "f.field", "language", "f.value").agg(_sorted_set("url").alias("urls")).where("size(urls) >= 2")
    return _finding(same, "metadata_duplicated", None, field="field", language="language", value="value", urls="urls")


def canonical_missing(c: Crawl) -> DataFrame:
    """*Whole.*  A page without a canonical on a site whose other pages have one."""
    pages = c.judged.where("whole and html_page").withColumn("n", F.size("metadata.canonicals"))
    having = pages.where("n > 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("having"))
    return _finding(pages.where("n = 0").join(having, "run_id"), "canonical_missing", F.col("url"), url="url", pagesDeclaringCanonical="having")


def _several_canonicals(c: Crawl) -> DataFrame:
    return c.judged.where("html_page and size(metadata.canonicals) >= 2")


@once
def _single_canonicals(c: Crawl) -> DataFrame:
    """(run_id, url, canonical) of pages that name one other page."""
    return c.judged.where("html_page and size(metadata.canonicals) = 1").select("run_id", "url", F.get("metadata.canonicals", F.lit(0)).alias("canonical")).where("canonical <> url")


def canonical_conflicting(c: Crawl) -> DataFrame:
    """Several canonicals, or one whose page names another page in turn."""
    rows = _several_canonicals(c).withColumn("list", F.array_sort("metadata.canonicals"))
    several = _finding(rows, "canonical_conflicting", F.col("url"), kind=F.lit("multiple"), url="url", canonicals="list")
    nxt = _single_canonicals(c).select("run_id", F.col("url").alias("canonical"), F.col("canonical").alias("further"))
    chain = _finding(_single_canonicals(c).join(nxt, ["run_id", "canonical"]), "canonical_conflicting", F.col("url"), kind=F.lit("chain"), url="url", canonical="canonical", targetCanonical="further")
    return several.unionByName(chain)


@once
def _broken_canonicals(c: Crawl) -> DataFrame:
    targets = c.judged.select("run_id", F.col("url").alias("canonical"), "failed", "http_status", "fetch_error")
    rows = _single_canonicals(c).join(targets, ["run_id", "canonical"], "left")
    failed = rows.where("failed").withColumn("kind", F.lit("failed"))
    unreached = c.whole_only(c.scoped(rows.where("failed is null"), "canonical")).withColumn("kind", F.lit("unreached"))
    return failed.unionByName(unreached)


def canonical_target_broken(c: Crawl) -> DataFrame:
    """A canonical that failed or, *whole*, that the crawl never recorded though in scope."""
    return _finding(_broken_canonicals(c), "canonical_target_broken", F.col("url"), kind="kind", url="url", canonical="canonical", httpStatus="http_status", fetchError="fetch_error")


@once
def _noindex(c: Crawl) -> DataFrame:
    """(run_id, url, channel, crawler, directive) of every statement that keeps a healthy page out."""
    pages = c.judged.where("not failed")
    meta = pages.select("run_id", "url", F.explode("metadata.robots").alias("r")).select("run_id", "url", F.lit("markup").alias("channel"), "r.crawler", F.explode("r.directives").alias("directive"))
    sent = pages.select("run_id", "url", F.explode(headers.robots_header(F.col("x_robots_tag"))).alias("r")).select("run_id", "url", F.lit("header").alias("channel"), "r.crawler", "r.directive")
    return meta.unionByName(sent).where(F.col("directive").isin("noindex", "none"))


def noindex_present(c: Crawl) -> DataFrame:
    """A page that asks not to be indexed, and the channels that ask."""
    both = c.judged.select("run_id", "url", (F.size("metadata.robots") > 0).alias("in_markup"), F.col("x_robots_tag").isNotNull().alias("in_header"))
    rows = _noindex(c).groupBy("run_id", "url").agg(F.array_sort(F.collect_set(F.struct("channel", "crawler", "directive"))).alias("sources"), _sorted_set("channel").alias("channels"))
    rows = rows.join(both, ["run_id", "url"])
    indexing = F.array_compact(F.array(F.when(F.col("in_header") & ~F.array_contains("channels", "header"), F.lit("header")), F.when(F.col("in_markup") & ~F.array_contains("channels", "markup"), F.lit("markup"))))
    return _finding(rows, "noindex_present", F.col("url"), url="url", sources="sources", channels="channels", indexingChannels=indexing)


def content_duplicated(c: Crawl) -> DataFrame:
    """*Whole.*  One text at several isolated pages, unless content_untranslated names just these
    or they name one canonical page."""
    rows = c.judged.where("whole and html_page and content.isolated and content.text_digest is not null")
    goal = F.when(F.size("metadata.canonicals") == 1, F.get("metadata.canonicals", F.lit(0))).otherwise(F.col("url"))
    same = rows.groupBy("run_id", F.col("content.text_digest").alias("digest")).agg(
        F.first("content.text_length").alias("length"), _sorted_set("url").alias("urls"), F.count_distinct(goal).alias("goals")
    ).where("size(urls) >= 2 and goals >= 2")
    return _finding(same.join(_identical(c).select("run_id", "urls"), ["run_id", "urls"], "left_anti"), "content_duplicated", None, digest="digest", textLength="length", urls="urls")


# ---------------------------------------------------------------- links and routes


def link_broken(c: Crawl) -> DataFrame:
    """A recorded page that failed and is linked; errors that may pass need a second look that agreed."""
    lasting = F.col("fetch_error").isNull() & F.col("http_status").between(400, 499)
    dead = c.scoped(c.judged.where("failed").where(lasting | F.coalesce("confirmed", F.lit(False))).select("run_id", F.col("url").alias("dst"), "http_status", "fetch_error", (~lasting).alias("confirmed")), "dst")
    spoken = hreflang_target_failed(c).select("run_id", F.get_json_object("detail", "$.target").alias("dst")).union(_broken_canonicals(c).select("run_id", F.col("canonical").alias("dst")))
    rows = c.links.join(dead, ["run_id", "dst"]).join(spoken, ["run_id", "dst"], "left_anti")
    rows = rows.groupBy("run_id", "dst", "http_status", "fetch_error", "confirmed").agg(_sorted_set("src").alias("linked"))
    return _finding(rows, "link_broken", None, target="dst", httpStatus="http_status", fetchError="fetch_error", confirmed="confirmed", linkedFrom="linked")


def link_external_broken(c: Crawl) -> DataFrame:
    """An outside target that is gone, if all outside targets were looked at."""
    gone = F.when(F.col("fetch_error").isNotNull(), F.coalesce("confirmed", F.lit(False))).otherwise(F.col("http_status").isin(404, 410))
    dead = c.external.where(gone).join(c.runs.where("external_complete").select("run_id"), "run_id", "left_semi").withColumnRenamed("url", "dst")
    rows = c.links.join(dead, ["run_id", "dst"]).groupBy("run_id", "dst", "http_status", "fetch_error", "confirmed").agg(_sorted_set("src").alias("linked"))
    return _finding(rows, "link_external_broken", None, target="dst", httpStatus="http_status", fetchError="fetch_error", confirmed="confirmed", linkedFrom="linked")


def redirect_chain(c: Crawl) -> DataFrame:
    """Routes of two or more real hops, and loops; each start once."""
    routes = c.recorded.select("run_id", F.col("redirect_chain").alias("chain"), F.col("url").alias("to")).unionByName(c.aliases.select("run_id", "chain", F.col("served").alias("to"))).where("size(chain) > 0")
    real = F.filter("chain", lambda h: ~page_url(h["url"]).eqNullSafe(page_url(h["location"])))
    visited = F.transform("chain", lambda h: h["url"])
    last = F.get("chain", F.size("chain") - 1)["location"]
    rows = routes.withColumns({"from": F.get("chain", F.lit(0))["url"], "hops": real, "loop": F.array_contains(visited, last) | (F.size(F.array_distinct(visited)) < F.size(visited))})
    rows = rows.where("coalesce(loop, false) or size(hops) >= 2").groupBy("run_id", "from").agg(F.max_by(F.struct("loop", "hops", "to"), F.struct("loop", F.size("hops"))).alias("r"))
    linked = c.links.groupBy("run_id", F.col("dst").alias("from")).agg(_sorted_set("src").alias("linked"))
    rows = rows.join(linked, ["run_id", "from"], "left").select("run_id", "from", "r.*", F.coalesce("linked", F.array().cast("array<string>")).alias("linked"))
    loop = F.coalesce("loop", F.lit(False))
    return _finding(rows, "redirect_chain", None, **{"kind": F.when(loop, "loop").otherwise("chain"), "from": "from", "to": F.when(~loop, F.col("to")), "hops": "hops", "linkedFrom": "linked"})


# ---------------------------------------------------------------- host, sitemap, robots


def certificate_problem(c: Crawl) -> DataFrame:
    """The certificate's foremost problem: expired, for another name, untrusted, or about to expire."""
    rows = c.certificates.join(c.runs.select("run_id", "now"), "run_id")
    days = F.floor((F.unix_timestamp("valid_to") - F.unix_timestamp("now")) / 86400).cast("int")
    kind = (
        F.when(F.col("valid_to") <= F.col("now"), "expired")
        .when(F.contains(F.upper("authorization_error"), F.lit("ALTNAME")), "hostname_mismatch")
        .when(F.col("authorization_error").isNotNull(), "untrusted_chain")
        .when(days <= S.CERTIFICATE_DAYS, "expiring_soon")
    )
    rows = rows.withColumns({"kind": kind, "days": days}).where("kind is not null")
    return _finding(rows, "certificate_problem", None, kind="kind", origin="origin", validTo="valid_to", daysRemaining="days", issuer="issuer", subject="subject", authorizationError="authorization_error")


def security_header_contradiction(c: Crawl) -> DataFrame:
    """A header whose value defeats it; *whole:* one that only some healthy pages send."""
    healthy = c.judged.where("not failed")
    sent = healthy.select("run_id", "url", "whole", F.explode("security_headers").alias("header", "value"))
    bad = sent.where(headers.malformed(F.col("header"), F.col("value"))).groupBy("run_id", "header").agg(F.min_by("value", "url").alias("value"), _sorted_set("url").alias("affected"))
    counts = sent.groupBy("run_id", "header").agg(F.count(F.lit(1)).alias("publishing"))
    malformed = _finding(bad.join(counts, ["run_id", "header"]), "security_header_contradiction", None, kind=F.lit("malformed"), header="header", value="value", affectedUrls="affected", pagesPublishing="publishing")
    all_pages = healthy.where("whole").groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))
    uneven = counts.join(all_pages, "run_id").where("publishing < pages").select("run_id", "header", "publishing")
    lacking = uneven.join(healthy.select("run_id", "url", "security_headers"), "run_id").where(~F.coalesce(F.map_contains_key("security_headers", F.col("header")), F.lit(False)))
    lacking = lacking.groupBy("run_id", "header", "publishing").agg(_sorted_set("url").alias("affected"))
    inconsistent = _finding(lacking, "security_header_contradiction", None, kind=F.lit("inconsistent"), header="header", value=F.lit(None).cast("string"), affectedUrls="affected", pagesPublishing="publishing")
    return malformed.unionByName(inconsistent)


def _with_sitemap(c: Crawl, df: DataFrame) -> DataFrame:
    return df.join(c.runs.select("run_id", "sitemap_source", "sitemap_discovery"), "run_id")


def sitemap_url_failed(c: Crawl) -> DataFrame:
    """*Whole.*  Sitemap entries that failed; one finding."""
    bad = c.judged.where("whole and failed").select("run_id", "url", "http_status", "fetch_error")
    entry = F.struct("raw", F.col("url").alias("normalised"), F.col("http_status").alias("httpStatus"), F.col("fetch_error").alias("fetchError"))
    rows = c.comparable_entries.join(bad, ["run_id", "url"]).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("url", entry.alias("e")))).alias("e"))
    return _finding(_with_sitemap(c, rows), "sitemap_url_failed", None, sitemapSource="sitemap_source", discovery="sitemap_discovery", entries=F.transform("e", lambda x: x["e"]))


def page_missing_from_sitemap(c: Crawl) -> DataFrame:
    """Live pages that the site's sitemap omits, unless they ask not to be indexed or name another page."""
    listed = c.sitemap.where("url is not null").select("run_id", "url").distinct()
    counts = c.sitemap.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))
    elsewhere = F.exists("metadata.canonicals", lambda x: x != F.col("url"))
    live = c.scoped(c.judged.where("html_page").where(~F.coalesce(elsewhere, F.lit(False))).select("run_id", "url"), "url")
    rows = live.join(counts, "run_id").join(listed, ["run_id", "url"], "left_anti").join(_noindex(c).select("run_id", "url"), ["run_id", "url"], "left_anti")
    rows = rows.groupBy("run_id", "entries").agg(_sorted_set("url").alias("urls"))
    return _finding(_with_sitemap(c, rows), "page_missing_from_sitemap", None, sitemapSource="sitemap_source", discovery="sitemap_discovery", sitemapEntryCount="entries", urls="urls")


def robots_blocks_indexable(c: Crawl) -> DataFrame:
    """Sitemap addresses that a robots rule keeps Googlebot from; one finding for each rule."""
    origin = c.runs.select("run_id", origin_of(F.col("base")).alias("origin"))
    paths = c.sitemap.where("url is not null").join(origin, "run_id").where(origin_of(F.col("url")) == F.col("origin")).select("run_id", "url", path_of(F.col("url")).alias("path")).distinct()
    blocked = verdicts(group_for(c.robots, "googlebot"), paths).where("not allowed")
    rows = blocked.groupBy("run_id", "rule").agg(_sorted_set("url").alias("urls"))
    return _finding(
        _with_sitemap(c, rows), "robots_blocks_indexable", None, rule=F.col("rule.pattern"), ruleLine=F.col("rule.line"), ruleLineNumber=F.col("rule.line_number"),
        userAgentGroup=F.col("rule.agent"), sitemapSource="sitemap_source", discovery="sitemap_discovery", urls="urls",
    )


def page_orphaned(c: Crawl) -> DataFrame:
    """*Whole.*  Sitemap addresses that nothing links to though the crawl saw a page above them."""
    runs = c.runs.where("crawl_complete and not coalesce(scope_narrowed, false)").select("run_id", "entry_url")
    either = lambda col: F.regexp_replace(col, "(?<=[^/:])/$", "")  # noqa: E731  both spellings of a trailing slash
    entries = c.comparable_entries.join(runs, "run_id").where(F.coalesce(either("url") != either("entry_url"), F.lit(True))).withColumn("key", either(F.col("url")))
    linked = c.links.select("run_id", either(F.col("dst")).alias("key"))
    routed = c.aliases.select("run_id", either(F.col("requested")).alias("key"))
    lonely = entries.join(linked, ["run_id", "key"], "left_anti").join(routed, ["run_id", "key"], "left_anti")
    seen = c.recorded.select("run_id", either(F.col("url")).alias("above"))
    above = lonely.select("run_id", "url", F.explode(ancestors(F.col("url"))).alias("a")).select("run_id", "url", either(F.col("a")).alias("above"))
    rows = above.join(seen, ["run_id", "above"], "left_semi").groupBy("run_id").agg(_sorted_set("url").alias("urls"))
    return _finding(_with_sitemap(c, rows), "page_orphaned", None, sitemapSource="sitemap_source", discovery="sitemap_discovery", urls="urls")


# ---------------------------------------------------------------- images, browser, pictures


def _image_rule(c: Crawl, kind: str, count: str, listed: str) -> DataFrame:
    rows = c.judged.where("html_page").where(f"images.{count} > 0")
    images = F.col(f"images.{listed}")
    return _finding(rows, kind, F.col("url"), url="url", count=F.col(f"images.{count}"), of=F.col("images.total"), images=images, listed=F.size(images))


def image_missing_dimensions(c: Crawl) -> DataFrame:
    """A page with images that declare no size."""
    return _image_rule(c, "image_missing_dimensions", "undimensioned", "undimensioned_urls")


def image_legacy_format(c: Crawl) -> DataFrame:
    """A page with raster images that it offers in no modern format."""
    return _image_rule(c, "image_legacy_format", "legacy", "legacy_urls")


def image_oversized(c: Crawl) -> DataFrame:
    """A page with images above the limit, if all images were weighed."""
    heavy = c.image_weights.where(f"bytes > {S.OVERSIZED_BYTES}").join(c.runs.where("weights_complete").select("run_id"), "run_id", "left_semi").select("run_id", F.col("url").alias("img"), "bytes")
    used = c.judged.where("html_page").select("run_id", "url", F.explode(F.array_distinct("images.urls")).alias("img"))
    rows = used.join(heavy, ["run_id", "img"]).groupBy("run_id", "url").agg(F.array_sort(F.collect_list(F.struct("img", "bytes"))).alias("i"))
    images = F.transform(F.slice("i", 1, S.MAX_LISTED_IMAGES), lambda x: F.struct(x["img"].alias("url"), x["bytes"].alias("bytes")))
    return _finding(rows, "image_oversized", F.col("url"), url="url", count=F.size("i"), thresholdBytes=F.lit(S.OVERSIZED_BYTES), images=images, listed=F.size(images))


def console_error(c: Crawl) -> DataFrame:
    """A page whose own scripts failed in the browser."""
    rows = c.observations.where("first_party_errors > 0")
    return _finding(rows, "console_error", F.col("url"), url="url", count="first_party_errors", thirdPartyCount="third_party_errors", messages="messages")


def visual_changed(c: Crawl) -> DataFrame:
    """A page whose picture differs from the baseline's by more than rendering noise."""
    rows = c.visual.where(bands.differs(F.col("comparable"), F.col("changed_pixels"), F.col("compared_pixels")))
    return _finding(
        rows, "visual_changed", F.col("url"), url="url", changedPixels="changed_pixels", comparedPixels="compared_pixels", regions="regions",
        regionsCapped="regions_capped", heightDelta="height_delta", thresholdShare=F.lit(S.MIN_CHANGED_SHARE),
    )


RULES = {name: globals()[name] for name in S.RULES}


def detect(c: Crawl, rule_set: list[str] | None = None) -> DataFrame:
    """All findings (see schema.FINDINGS), in the order of rules, then addresses, then details."""
    found = None
    for at, name in enumerate(rule_set or S.RULES):
        rows = RULES[name](c).withColumn("rule", F.lit(at))
        found = rows if found is None else found.unionByName(rows)
    order = ["run_id", "rule", "url", "detail"]  # NULL comes first
    # sorted by ranges; a finding's number is what its run has in the ranges before, and its place in its own
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()})
    ranged = stored(ranged)
    counts = ranged.groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("run_id", "part", "first", before.alias("before"))
    return ranged.join(starts, ["run_id", "part"]).select("run_id", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("ord"), "type", "url", "detail")
