"""Comparing and painting pictures against plain loops over their pixels."""

import time

import numpy as np
import pytest

from lingoscope.functions import pixels
from lingoscope.plans import picture_queries
from lingoscope.sources import snapshots

SF = "/root/testdata/sf0.001"


def luma(p):
    return float(p[0]) * 0.29889531 + float(p[1]) * 0.58662247 + float(p[2]) * 0.11448223


def around(im, y, x):
    return [(v, u) for u in range(x - 1, x + 2) for v in range(y - 1, y + 2) if (v, u) != (y, x) and 0 <= v < len(im) and 0 <= u < len(im[0])]


def edge(im, y, x):
    return y in (0, len(im) - 1) or x in (0, len(im[0]) - 1)


def flat(im, place):
    return edge(im, *place) + sum(im[v][u] == im[place[0]][place[1]] for v, u in around(im, *place)) >= 3


def on_edge(im, other, y, x):
    steps = [(luma(im[y][x]) - luma(im[v][u]), (v, u)) for v, u in around(im, y, x)]
    if edge(im, y, x) + sum(d == 0 for d, _ in steps) > 2:
        return False
    down, up = min((d for d, _ in steps), default=0), max((d for d, _ in steps), default=0)
    if down >= 0 or up <= 0:
        return False
    dark, light = (next(at for d, at in steps if d == which) for which in (down, up))
    return any(flat(im, at) and flat(other, at) for at in (dark, light))


def plain(a, b):
    a, b = a.tolist(), b.tolist()
    changed, smooth = set(), set()
    for y in range(len(a)):
        for x in range(len(a[0])):
            r, g, c = (float(p) - q for p, q in zip(a[y][x], b[y][x]))
            distance = 0.5053 * (r * 0.29889531 + g * 0.58662247 + c * 0.11448223) ** 2 + 0.299 * (r * 0.59597799 - g * 0.2741761 - c * 0.32180189) ** 2 + 0.1957 * (r * 0.21147017 - g * 0.52261711 + c * 0.31114694) ** 2
            if distance > 35215 * 0.1**2:
                (smooth if on_edge(a, b, y, x) or on_edge(b, a, y, x) else changed).add((y, x))
    return changed, smooth


def places(mask):
    return set(zip(*map(list, np.nonzero(mask))))


def disc(size, cx, cy, r, colour=(200, 30, 40)):
    y, x = np.mgrid[:size, :size]
    share = np.clip(r + 0.5 - np.hypot(x - cx, y - cy), 0, 1)[..., None]
    return (255 * (1 - share) + np.array(colour) * share).astype(np.uint8)


CASES = {
    "moved by half a pixel": (disc(40, 20, 20, 12), disc(40, 20.5, 20.2, 12)),
    "larger": (disc(40, 20, 20, 9), disc(40, 20, 20, 14)),
    "cut by the edges": (disc(31, 0, 2, 15), disc(31, 0.6, 2, 15)),
    "few colours": tuple(np.random.default_rng(s).choice([0, 120, 255], (24, 19, 1)).repeat(3, 2).astype(np.uint8) for s in (1, 2)),
    "noise": tuple(np.random.default_rng(s).integers(0, 256, (24, 19, 3)).astype(np.uint8) for s in (1, 2)),
    "one column": tuple(np.random.default_rng(s).integers(0, 256, (9, 1, 3)).astype(np.uint8) for s in (1, 2)),
    "one pixel": (np.zeros((1, 1, 3), np.uint8), np.full((1, 1, 3), 255, np.uint8)),
}


@pytest.mark.parametrize("strip", [7, 1 << 19])
@pytest.mark.parametrize("name", CASES)
def test_as_pixel_by_pixel(monkeypatch, name, strip):
    monkeypatch.setattr(pixels, "STRIP", strip)
    a, b = CASES[name]
    changed, smooth = pixels.compared(a, b)
    assert (places(changed), places(smooth)) == plain(a, b)
    image = snapshots.decode(pixels.encode(pixels.painted(a, changed, smooth)))
    want = [[[255, 0, 0] if changed[y, x] else [255, 255, 0] if smooth[y, x] else [int(255 + (luma(a[y, x]) - 255) * 0.1)] * 3 for x in range(a.shape[1])] for y in range(len(a))]
    assert image.tolist() == want


def test_cases_hold_smoothed_edges():
    both = [plain(a, b) for a, b in CASES.values()]
    assert sum(bool(s) for _, s in both) >= 4 and sum(bool(c) for c, _ in both) >= 4
    changed, smooth = both[0]
    assert len(smooth) > len(changed)


def test_regions_of_many_boxes():
    mask = np.zeros((200, 300), bool)
    mask[::33, ::33] = True
    mask[60:100, 10:20] = True
    boxes, capped = snapshots.regions(mask)
    assert capped and len(boxes) == 8 and boxes[0] == {"x": 0, "y": 32, "width": 48, "height": 80}  # with the cells of dots beside it
    assert [(b["y"], b["x"]) for b in boxes[1:]] == sorted((b["y"], b["x"]) for b in boxes[1:])


def test_a_full_page_pair_takes_seconds():
    rng = np.random.default_rng(3)
    a = np.full((9627, 1280, 3), 255, np.uint8)
    a[::5] = rng.integers(0, 256, (1926, 1280, 3))
    b = a.copy()
    b[2000:2600, 200:900] = rng.integers(0, 256, (600, 700, 3))
    began = time.time()
    changed, smooth = pixels.compared(a, b)
    assert changed.any() and time.time() - began < 12


def test_pages_as_drawn(spark):
    pairs = picture_queries.page_pictures(spark, SF).collect()
    got = {r["url"]: r for r in picture_queries.picture_changes(spark, SF).collect()}
    shown = {r["url"]: r["overlay"] for r in picture_queries.picture_overlays(spark, SF).collect()}
    assert len(got) == len(shown) == len(pairs)
    seen = set()
    for r in pairs:
        row, other = got[r["url"]], int(r["url"]) % 11 == 5
        reason = "viewport_differs" if other else "masks_differ" if int(r["url"]) % 13 == 6 else None
        seen.add(reason)
        assert row["reason"] == reason and (shown[r["url"]] is None) == (reason is not None)
        if reason:
            continue
        a, b = snapshots.decode(r["picture"]), snapshots.decode(r["baseline"])
        height = min(len(a), len(b))
        changed, smooth = plain(b[:height], a[:height])
        assert (row["changed_pixels"], row["compared_pixels"], row["height_delta"]) == (len(changed), height * picture_queries.WIDE, len(a) - len(b))
        overlay = snapshots.decode(shown[r["url"]])
        assert places((overlay == (255, 0, 0)).all(-1)) == changed and places((overlay == (255, 255, 0)).all(-1)) == smooth
        boxes = [tuple(map(int, b.split())) for b in row["regions"].split("|") if b]
        if changed and not row["regions_capped"]:
            assert all(any(x0 <= x < x0 + w and y0 <= y < y0 + h for x0, y0, w, h in boxes) for y, x in changed)
            assert row["lowest"] == pytest.approx(max(y + h for _, y, _, h in boxes) / len(a), abs=1e-5)
    assert seen == {None, "viewport_differs", "masks_differ"}
