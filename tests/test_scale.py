"""Rules on large families and long robots files, and both against plain versions."""

import random
import re
import time

from crawls import BASE, crawl, found, page
from pyspark.sql import functions as F

from lingoscope.plans.rules import RULES
from lingoscope.sources import robots


def plain_defects(pages):
    """Defects of one family: (url, kind, sibling, sibling's locale), over all pairs of members."""
    out = set()
    for u, locale, own in pages:
        for v, other, others in pages:
            if u != v and locale[:2] != other[:2] and other[:2] not in {k[:2] for k in own}:
                kind = "not_reciprocated" if u in others.values() else "incomplete" if own else None
                out |= {(BASE + u, kind, BASE + v, other)} if kind else set()
        if own and locale[:2] not in {k[:2] for k in own}:
            out.add((BASE + u, "no_self_reference", None, None))
    return out


def test_family_defects_as_over_all_pairs(spark):
    rng = random.Random(6)
    for _ in range(2):
        names = [f"/{rng.choice(['en', 'de', 'fr', 'it'])}/{i}" for i in range(14)]
        own = {u: {u[1:3]: u} | {v[1:3]: v for v in rng.sample(names, rng.randrange(4))} if rng.random() < 0.8 else {rng.choice(["en", "de"]): rng.choice(names)} for u in names}
        c = crawl(spark, [page(u, hreflang=own[u]) for u in names])
        members = {(r["url"].removeprefix(BASE), r["group_key"]): r["locale"] for r in c.members.collect()}
        want = set()
        for group in {g for _, g in members if g is not None}:
            want |= plain_defects([(u, members[u, g], own[u]) for u, g in members if g == group and members[u, g]])
        got = {(x["url"], x["kind"], x.get("sibling"), x.get("siblingLocale")) for _, d in found(c, "hreflang_family_inconsistent") for x in d["defects"]}
        assert got == want and want


def test_one_family_of_ten_thousand_pages(spark):
    """Every page names the start as its default, so a whole site is one family."""
    n = 5000
    pages = [page("/", hreflang={"x-default": "/", "en": "/"})]
    for i in range(n):
        both = {"en": f"/en/{i}", "de": f"/de/{i}", "x-default": "/"}
        pages += [page(f"/en/{i}", hreflang=both), page(f"/de/{i}", hreflang=both)]
    pages.append(page("/de/alone", hreflang={"de": "/de/alone", "x-default": "/"}))
    c = crawl(spark, pages)
    began = time.time()
    (_, d), = found(c, "hreflang_family_inconsistent")
    assert {x["url"] for x in d["defects"] if x["kind"] == "incomplete"} >= {f"{BASE}/de/alone"} and len(d["memberUrls"]) == 2 * n + 2
    assert sum(x["url"] == f"{BASE}/de/alone" for x in d["defects"]) >= n
    assert time.time() - began < 120


def plain_verdict(rules, path):
    fits = []
    for place, (kind, pattern) in enumerate(rules):
        bare, anchored = (pattern[:-1], True) if pattern.endswith("$") else (pattern, False)
        if "?" not in pattern and re.match(".*".join(map(re.escape, bare.split("*"))) + (r"\Z" if anchored else ""), path, re.S):
            fits.append((len(pattern), kind == "allow", -place, kind, pattern))
    return max(fits)[3:] if fits else (None, None)


def test_robots_against_every_rule(spark):
    rng = random.Random(8)
    bit = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 5)))
    rules = {run: [(rng.choice(["allow", "disallow"]), "/" * (rng.random() < 0.9) + rng.choice(["", "*"]) + bit() + rng.choice(["", "", "*", "$", "*" + bit(), "?x", "*" + bit() + "$"])) for _ in range(40)] for run in ("r", "s")}
    body = {run: "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rows) for run, rows in rules.items()}
    parsed = robots.group_for(robots.parse(spark.createDataFrame(list(body.items()), "run_id string, body string")), "any")
    paths = [(run, "/" + bit() + bit() * rng.randrange(3), "kept") for run in ("r", "s", "none") for _ in range(150)]
    got = robots.verdicts(parsed, spark.createDataFrame(paths, "run_id string, path string, kind2 string")).select("run_id", "path", "rule.kind", "rule.pattern", "allowed").distinct().collect()
    want = {(run, path, *(v := plain_verdict(rules.get(run, []), path)), v[0] != "disallow") for run, path, _ in paths}
    assert set(map(tuple, got)) == want


def test_a_thousand_rules_meet_few_paths(spark):
    """A path is tried against rules that share its beginning."""
    body = "User-agent: *\n" + "\n".join(f"Disallow: /section-{i}/*/private" for i in range(1000))
    rules = robots.group_for(robots.parse(spark.createDataFrame([("r", body)], "run_id string, body string")), "any")
    paths = spark.range(20000).select(F.lit("r").alias("run_id"), F.format_string("/section-%d/x/%s", F.col("id") % 2000, F.when(F.col("id") % 3 == 0, "private").otherwise("open")).alias("path"))
    out = robots.verdicts(rules, paths)
    assert out.where("not allowed").count() == sum(i % 2000 < 1000 and i % 3 == 0 for i in range(20000))
    joins = [n for n in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in n]
    assert any("_head" in n for n in joins)
    assert set(RULES) >= {"hreflang_family_inconsistent"}
