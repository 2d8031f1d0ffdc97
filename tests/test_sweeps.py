"""Sweeps against a plain one that asks an address after the other."""

import random

from lingoscope.sources import sweeps

ATTEMPTS = "run_id string, place int, url string, nth int, http_status int, fetch_error string, content_length string"
LIMITS = "run_id string, max_requests int"


def host_of(url):
    return url.split("/")[2] if "://" in url else None


def asked_in_order(urls, answers, most, external):
    """``answers``: url -> list of (status, error, length) that its requests give."""
    found, refused, made, lost = [], set(), 0, 0
    for url in urls:
        if made >= most or (made >= 20 and lost / made >= 0.3):
            return found, False
        if external and host_of(url) in refused:
            continue
        given = iter([*answers[url], (None, None, None)])
        made += 1
        status, error, length = next(given)
        if status in (405, 501):
            made += 1
            status, error, length = next(given)
        if external and status == 429:
            if host_of(url):
                refused.add(host_of(url))
            continue
        if error is not None:
            lost += 1
            if external:
                made += 1
                again, second, _ = next(given)
                found.append((url, again, second or error, second is not None))
        elif external:
            found.append((url, status, None, False))
        elif status is not None and 200 <= status <= 299:
            found.append((url, int(length) if length and length.isdigit() else None))
    return found, True


def crawl(seed, n, bad):
    rng = random.Random(seed)
    answers = {}
    for i in range(n):
        url = "nowhere" + str(i) if rng.random() < 0.03 else f"https://h{rng.randrange(9)}.example/{i}"
        one = lambda: (None, "timeout", None) if rng.random() < bad else (rng.choice([200, 200, 200, 204, 301, 403, 404, 405, 410, 429, 501, 500]), None, rng.choice(["7", "900000", None, "x"]))
        answers[url] = [one() for _ in range(3)]
    return answers


def test_as_asked_one_by_one(spark):
    cases = {f"r{s}": (crawl(s, n, bad), most) for s, (n, bad, most) in enumerate([(60, 0.02, 10**6), (60, 0.5, 10**6), (200, 0.25, 10**6), (80, 0.1, 30), (30, 0, 0), (1, 1, 5), (300, 0.05, 10**6), (21, 0.3, 20)])}
    rows = [(run, at, url, nth, *a) for run, (answers, _) in cases.items() for at, (url, tries) in enumerate(answers.items()) for nth, a in enumerate(tries, 1)]
    random.Random(1).shuffle(rows)
    attempts = spark.createDataFrame(rows + rows[:50], ATTEMPTS).repartition(5)
    limits = spark.createDataFrame([(run, most) for run, (_, most) in cases.items()] + [("empty", 3)], LIMITS)
    for external, sweep in ((True, sweeps.external_sweep), (False, sweeps.image_sweep)):
        found, complete = sweep(attempts, limits)
        got = {run: [] for run in cases}
        for r in found.collect():
            got[r["run_id"]].append(tuple(r)[1:])
        want = {run: asked_in_order(answers, answers, most, external) for run, (answers, most) in cases.items()}
        assert {run: sorted(v, key=repr) for run, v in got.items()} == {run: sorted(v, key=repr) for run, (v, _) in want.items()}
        assert {r["run_id"]: r["complete"] for r in complete.collect()} == {"empty": True} | {run: done for run, (_, done) in want.items()}
        assert {done for _, done in want.values()} == {True, False}


def test_no_attempts(spark):
    found, complete = sweeps.external_sweep(spark.createDataFrame([], ATTEMPTS), spark.createDataFrame([], LIMITS))
    assert found.count() == 0 and complete.count() == 0


def test_rows_that_say_nothing(spark):
    rows = [("r", 1, "https://a.example/", 1, 405, None, None), ("r", 2, None, 1, 200, None, "5"), ("r", None, "https://b.example/", 1, None, None, None), ("r", 3, "https://c.example:443/", 1, 429, None, None), ("r", 4, "http://C.example/x", 1, 200, None, None)]
    found, complete = sweeps.external_sweep(spark.createDataFrame(rows, ATTEMPTS), spark.createDataFrame([("r", 100)], LIMITS))
    got = {r["url"]: (r["http_status"], r["fetch_error"], r["confirmed"]) for r in found.collect()}
    assert got == {"https://a.example/": (None, None, False), None: (200, None, False), "https://b.example/": (None, None, False)}
    assert complete.first()["complete"]
