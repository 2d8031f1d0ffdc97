"""Sentences of reports over orders and parts in the roles of runs and changed pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingoscope.functions import bands, sentences
from lingoscope.plans.catalogue import joined, query, table
from lingoscope.schema import RULES

_KIND = "list_extract([" + ", ".join(f"'{name}'" for name in RULES) + "], CAST(p_partkey % 30 AS INTEGER) + 1)"


def _case(key: str, words: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{name}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for name, text in words.items()) + " END"


_RUN = """SELECT *, CASE WHEN lim THEN 'page_limit' WHEN NOT whole THEN 'stopped_early' WHEN whole THEN 'whole_crawl' ELSE 'not_recorded' END AS crawl FROM (
    SELECT o_orderkey, o_custkey, o_totalprice > 400000 AS lim, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority NOT LIKE '2%' END AS whole, o_orderkey % 4 AS k, o_custkey % 5 AS pic FROM orders)"""


def _runs(spark, sf_dir):
    k, pic = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    none = F.array().cast("array<string>")
    path = lambda name: F.concat(F.lit(f"/{name}"), F.col("o_custkey").cast("string"))
    scope = F.struct(F.when(k.isin(1, 3), F.array(path("a"), path("b"))).otherwise(none).alias("include_paths"), F.when(k >= 2, F.array(path("x"))).otherwise(none).alias("exclude_paths"))
    whole = F.when(~F.startswith("o_orderpriority", F.lit("5")), ~F.startswith("o_orderpriority", F.lit("2")))
    pictures = F.when(pic != 0, F.struct((pic != 1).alias("complete"), F.when(pic != 2, F.lit("b")).alias("baseline_run_id"), F.when(pic == 3, 0).otherwise(7).alias("watched")))
    rules = F.when(k != 2, F.array(F.lit("link_broken")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", bands.crawl_coverage(whole, F.col("o_totalprice") > 400000).alias("crawl"), scope.alias("scope"), bands.rules_coverage(rules)["kind"].alias("rules"), bands.picture_coverage(pictures).alias("pictures"),
    )


@query(f"""WITH r AS ({_RUN}), s AS (SELECT o_orderkey, [{_case("crawl", sentences.CRAWL)},
    CASE k WHEN 0 THEN NULL WHEN 1 THEN 'This check was scoped to part of the site — limited to /a' || o_custkey || ', /b' || o_custkey || '.' WHEN 2 THEN 'This check was scoped to part of the site — excluding /x' || o_custkey || '.'
        ELSE 'This check was scoped to part of the site — limited to /a' || o_custkey || ', /b' || o_custkey || ', excluding /x' || o_custkey || '.' END,
    CASE WHEN k = 2 THEN '{sentences.RULES_UNKNOWN}' END] AS told, [{_case("crawl", sentences.CLIENT_CRAWL)}, CASE WHEN k > 0 THEN '{sentences.CLIENT_NARROWED}' END, CASE WHEN k = 2 THEN '{sentences.CLIENT_RULES_UNKNOWN}' END,
    CASE pic WHEN 1 THEN '{sentences.CLIENT_PICTURES["unavailable"]}' WHEN 2 THEN '{sentences.CLIENT_PICTURES["no_baseline"]}' WHEN 3 THEN '{sentences.CLIENT_PICTURES["nothing_watched"]}'
        WHEN 4 THEN 'Appearance was compared on 7 of ' || o_custkey || ' pages against a reference set earlier.' END] AS client FROM r)
    SELECT o_orderkey, array_to_string(list_filter(told, lambda x: x IS NOT NULL), '|') AS told, array_to_string(list_filter(client, lambda x: x IS NOT NULL), '|') AS client FROM s""")
def coverage_told(spark, sf_dir):
    """What each run says about what it didn't cover, in both registers."""
    told = sentences.coverage_sentences(F.col("crawl"), F.col("scope"), F.col("rules"))
    client = sentences.client_coverage_sentences(F.col("crawl"), bands.scope_coverage(F.col("scope")), F.col("rules"), F.col("pictures"), F.lit(7), F.col("o_custkey"))
    return _runs(spark, sf_dir).select("o_orderkey", joined(told).alias("told"), joined(client).alias("client"))


@query(f"""WITH f AS (SELECT *, {_KIND} AS kind FROM part) SELECT p_partkey, {_case("kind", sentences.LABELS)} AS label, {_case("kind", sentences.CLIENT_LABELS)} AS client FROM f""")
def finding_labels(spark, sf_dir):
    """Both names of a finding's kind; NULL for a kind that isn't known."""
    kind = F.get(F.array(*map(F.lit, RULES)), (F.col("p_partkey") % 30).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sentences.label(kind).alias("label"), sentences.client_label(kind).alias("client"))


@query("""WITH f AS (SELECT p_partkey AS p, p_size AS s, p_partkey % 3 AS k, p_partkey % 5 - 2 AS h FROM part)
    SELECT p, CASE WHEN p % 7 = 0 THEN 'Differs from the baseline' ELSE format('{:,}', p * 1003) || ' of ' || format('{:,}', p * 20011 + 1) || ' compared pixels differ, in ' || CASE k WHEN 0 THEN '0 regions' WHEN 1 THEN '1 region' ELSE '3 regions' END || CASE WHEN p % 2 = 0 THEN ' or more' ELSE '' END END AS sentence,
    CASE k WHEN 0 THEN '' WHEN 1 THEN s || ' × 16 at 0, ' || p ELSE (s + 1) || ' × 20 at 3, 4|' || s || ' × 16 at 0, ' || p || '|' || '16 × ' || s || ' at 1, 2' END AS regions,
    CASE WHEN h <> 0 THEN 'The page is ' || abs(h) || 'px ' || CASE WHEN h < 0 THEN 'shorter' ELSE 'taller' END || ' than the baseline' END AS height,
    CASE WHEN p % 4 > 0 THEN 'Reported above ' || CASE p % 4 WHEN 1 THEN '0.05' WHEN 2 THEN '20' ELSE '12.3457' END || '% of the compared area' END AS threshold FROM f""")
def visual_told(spark, sf_dir):
    """What is said of a changed picture, its regions, its length and the threshold."""
    p, s = F.col("p_partkey"), F.col("p_size").cast("int")
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    first, second, third = box(F.lit(0), p, s, F.lit(16)), box(F.lit(1), F.lit(2), F.lit(16), s), box(F.lit(3), F.lit(4), s + 1, F.lit(20))
    boxes = F.when(p % 3 == 1, F.array(first)).when(p % 3 == 2, F.array(first, second, third, box(F.lit(0), F.lit(0), F.lit(None), F.lit(9))))
    share = F.when(p % 4 == 1, 0.0005).when(p % 4 == 2, 0.2).when(p % 4 == 3, 0.123456789)
    told = sentences.visual_change(F.when(p % 7 != 0, p * 1003), p * 20011 + 1, boxes, p % 2 == 0, p % 5 - 2, share)
    rows = table(spark, sf_dir, "part").select(p.alias("p"), told.alias("t"))
    return rows.select("p", "t.sentence", joined(F.col("t.regions")).alias("regions"), "t.height", "t.threshold")
