"""Sitemap trees against a plain reader that takes one document after the other."""

import random

from lingoscope.sources import sitemap

SITE = "https://a.example/"


def read_in_turn(roots, bodies, documents, entries_at_most):
    queue, seen, read, out = list(roots), set(roots), 0, []
    while queue and read < documents:
        one = queue.pop(0)
        if bodies.get(one) is None:
            continue
        read += 1
        index, names = bodies[one]
        for name in names:
            if index and SITE + name not in seen:
                seen.add(SITE + name)
                queue.append(SITE + name)
            elif not index and len(out) < entries_at_most:
                out.append((name, SITE + name, one))
    return out


def tree(seed):
    rng = random.Random(seed)
    bodies = {}
    for k in range(30):
        index = rng.random() < 0.4
        names = [f"s{rng.randrange(34)}" if index else f"p{rng.randrange(1000)}" for _ in range(rng.randrange(7))]
        bodies[f"{SITE}s{k}"] = None if rng.random() < 0.15 else (index, names)
    return rng.sample(sorted(bodies), rng.choice([1, 2, 4])), bodies


def test_as_read_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(sitemap, "MAX_SITEMAPS", 9)
    monkeypatch.setattr(sitemap, "MAX_URLS", 14)
    runs = {f"r{s}": tree(s) for s in range(12)}
    rows = []
    for run, (_, bodies) in runs.items():
        for address, body in bodies.items():
            kind = None if body is None else ("sitemapindex" if body[0] else "urlset")
            text = body and f"<{kind}>" + "<loc> </loc>".join(f"<loc>{name}</loc>" for name in body[1]) + f"</{kind}>"
            rows.append((run, address, text))
    random.Random(0).shuffle(rows)
    roots = [(run, address, at) for run, (named, _) in runs.items() for at, address in enumerate(named)]
    got = sitemap.read_tree(spark.createDataFrame(roots, "run_id string, sitemap string, place int"), spark.createDataFrame(rows, "run_id string, sitemap string, text string").repartition(4)).collect()
    want = {run: read_in_turn(*case, 9, 14) for run, case in runs.items()}
    for run in runs:
        mine = sorted((r["place"], r["raw"], r["url"], r["source"]) for r in got if r["run_id"] == run)
        assert mine == [(at, *entry) for at, entry in enumerate(want[run], 1)], run
    assert max(map(len, want.values())) == 14 and any(0 < len(v) < 14 for v in want.values())


def test_no_sitemaps(spark):
    none = spark.createDataFrame([], "run_id string, sitemap string, text string")
    assert sitemap.read_tree(none.select("run_id", "sitemap"), none).count() == 0
