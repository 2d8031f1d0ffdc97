"""Hand-built crawls whose default is that no rule has anything to say."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession

from lingoscope import schema as S
from lingoscope.plans.rules import RULES, Crawl

BASE = "https://shop.test"


def absolute(u: str) -> str:
    return BASE + u if u.startswith("/") else u


def page(path, status=200, error=None, hreflang=None, links=(), html=True, isolated=False, digest=None, length=0, markers=(), blocks=(), title="", description="", canonicals=(), robots=(), images=(0, 0, 0, (), (), ()), x_robots=None, headers=None, chain=(), run="r"):
    title = f"Title of {path}" if title == "" else title
    description = f"Description of {path}" if description == "" else description
    return (
        run, absolute(path), status, error, {k: absolute(v) for k, v in (hreflang or {}).items()}, [absolute(x) for x in links],
        (html, isolated, digest, length, list(markers), tuple(b in blocks for b in S.BLOCKS)),
        (title, description, [absolute(x) for x in canonicals], [(c, list(d)) for c, d in robots]),
        None if images is None else (*images[:3], *(list(map(absolute, x)) for x in images[3:])),
        x_robots, headers or {}, [(absolute(u), s, absolute(to)) for u, s, to in chain],
    )


def crawl(spark: SparkSession, pages, locales=(), complete=True, narrowed=False, entry=None, external_complete=False, weights_complete=True, include=(), exclude=(), now=dt.datetime(2026, 1, 1), **tables) -> Crawl:
    run = ("r", BASE + "/", complete, narrowed, entry, list(locales), list(include), list(exclude), [], external_complete, weights_complete, True, "sitemap.xml", "robots", now)
    kinds = {"reverified": S.REVERIFIED, "aliases": S.ALIASES, "external": S.EXTERNAL, "image_weights": S.IMAGE_WEIGHTS, "sitemap": S.SITEMAP, "robots": S.ROBOTS, "certificates": S.CERTIFICATES, "observations": S.OBSERVATIONS, "visual": S.VISUAL}
    frames = {k: spark.createDataFrame([("r", *row) for row in rows], kinds[k]) for k, rows in tables.items()}
    return Crawl(spark, spark.createDataFrame(pages, S.PAGES), spark.createDataFrame([run], S.RUNS), **frames)


def found(c: Crawl, rule: str) -> list[tuple]:
    """(path, detail) of a rule's findings, in order."""
    rows = [(r["url"], json.loads(r["detail"])) for r in RULES[rule](c).collect()]
    return sorted(((u and u.removeprefix(BASE), d) for u, d in rows), key=lambda x: (x[0] or "", json.dumps(x[1], sort_keys=True)))
