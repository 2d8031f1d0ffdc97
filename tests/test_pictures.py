import time

import numpy as np
import pytest

from lingoscope.sources import snapshots


def filtered(pixels, kinds):
    """Rows with their filters applied, byte by byte as the format defines them."""
    height, width, n = pixels.shape
    rows = pixels.reshape(height, width * n).astype(int).tolist()
    out = []
    for y in range(height):
        line = []
        for i in range(width * n):
            a = rows[y][i - n] if i >= n else 0
            b = rows[y - 1][i] if y else 0
            c = rows[y - 1][i - n] if y and i >= n else 0
            nearest = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line.append((rows[y][i] - [0, a, b, (a + b) // 2, nearest][kinds[y]]) % 256)
        out.append(line)
    return np.array(out, np.uint8).reshape(height, width, n)


@pytest.mark.parametrize("shape", [(1, 1, 3), (40, 1, 4), (1, 30, 1), (23, 17, 3), (60, 9, 4), (50, 31, 2)])
@pytest.mark.parametrize("odds", [(1, 1, 1, 1, 1), (5, 3, 3, 0, 1), (0, 0, 0, 1, 1)])
def test_rows_come_back_from_any_filters(monkeypatch, shape, odds):
    rng = np.random.default_rng(shape[0])
    pixels = rng.integers(0, 256, shape).astype(np.uint8)
    kinds = rng.choice(5, shape[0], p=np.array(odds) / sum(odds)).astype(np.uint8)
    lines = filtered(pixels, kinds)
    assert (snapshots._unfiltered(kinds, lines) == pixels).all()
    monkeypatch.setattr(snapshots, "DIAGONAL", 7)
    assert (snapshots._unfiltered(kinds, lines) == pixels).all()


def test_a_full_page_takes_seconds():
    rng = np.random.default_rng(1)
    kinds = rng.choice([3, 4], 3000).astype(np.uint8)
    lines = rng.integers(0, 256, (3000, 1280, 4)).astype(np.uint8)
    began = time.time()
    snapshots._unfiltered(kinds, lines)
    assert time.time() - began < 10


def test_an_unknown_filter_is_an_error():
    with pytest.raises(ValueError):
        snapshots._unfiltered(np.array([5], np.uint8), np.zeros((1, 2, 3), np.uint8))
