"""What differs between two pictures, and pictures of it, in numpy over whole strips of rows.

Pictures are arrays (height, width, 3).  Pixels differ by a weighted distance in a
luma-chroma space; those that differ only because an edge was smoothed otherwise
aren't counted as changed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lingoscope.schema import PIXEL_THRESHOLD

#: Weights of the YIQ space, of distances in it, and the largest of these.
LUMA = (0.29889531, 0.58662247, 0.11448223)
CHROMA_I = (0.59597799, -0.27417610, -0.32180189)
CHROMA_Q = (0.21147017, -0.52261711, 0.31114694)
DISTANCE = (0.5053, 0.299, 0.1957)
LARGEST = 35215
#: Fixed values of a painted comparison: changed, smoothed, and how much of the baseline shows.
RED, YELLOW, SHOWN = (255, 0, 0), (255, 255, 0), 0.1

STRIP = 1 << 19  # pixels that are looked at together
_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def _weighed(pixels: np.ndarray, weights: tuple) -> np.ndarray:
    return pixels[..., 0] * weights[0] + pixels[..., 1] * weights[1] + pixels[..., 2] * weights[2]


def _distant(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    d = a.astype(np.float64) - b
    return sum(w * _weighed(d, axis) ** 2 for w, axis in zip(DISTANCE, (LUMA, CHROMA_I, CHROMA_Q))) > LARGEST * threshold**2


def _at_edge(picture: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (y == 0) | (x == 0) | (y == picture.shape[0] - 1) | (x == picture.shape[1] - 1)


def _near(picture: np.ndarray, y: np.ndarray, x: np.ndarray):
    """For each of the eight directions: coordinates of the neighbours, and which of them are in the picture."""
    for dx, dy in _AROUND:
        ny, nx = y + dy, x + dx
        inside = (ny >= 0) & (nx >= 0) & (ny < picture.shape[0]) & (nx < picture.shape[1])
        yield np.where(inside, ny, y), np.where(inside, nx, x), inside


def _flat(picture: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixels with at least three neighbours of just their colour (two at the edge)."""
    alike = _at_edge(picture, y, x).astype(np.int8)
    for ny, nx, inside in _near(picture, y, x):
        alike += inside & (picture[y, x] == picture[ny, nx]).all(-1)
    return alike > 2


def _smoothed(a: np.ndarray, b: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which pixels of ``a`` lie on a smoothed edge: between a darker and a lighter neighbour, one of them flat in both pictures."""
    own = _weighed(a[y, x].astype(np.float64), LUMA)
    alike, low, high = _at_edge(a, y, x).astype(np.int8), np.zeros(len(y)), np.zeros(len(y))
    lowest, highest = np.stack([y, x]), np.stack([y, x])
    for ny, nx, inside in _near(a, y, x):
        delta = np.where(inside, own - _weighed(a[ny, nx].astype(np.float64), LUMA), np.nan)
        alike += delta == 0
        for least, at, beyond in ((low, lowest, delta < low), (high, highest, delta > high)):
            least[beyond] = delta[beyond]
            at[:, beyond] = ny[beyond], nx[beyond]
    out = (alike <= 2) & (low < 0) & (high > 0)
    (ly, lx), (hy, hx) = lowest[:, out], highest[:, out]
    out[out] = (_flat(a, ly, lx) & _flat(b, ly, lx)) | (_flat(a, hy, hx) & _flat(b, hy, hx))
    return out


def compared(a: np.ndarray, b: np.ndarray, threshold: float = PIXEL_THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the pixels that changed, and of those that only an edge's smoothing changed."""
    height, width = a.shape[:2]
    distant = np.zeros((height, width), bool)
    rows = max(1, STRIP // max(1, width))
    for top in range(0, height, rows):
        distant[top : top + rows] = _distant(a[top : top + rows], b[top : top + rows], threshold)
    smooth = np.zeros_like(distant)
    places = np.flatnonzero(distant)
    for at in range(0, len(places), STRIP):
        y, x = np.divmod(places[at : at + STRIP], width)
        smooth[y, x] = _smoothed(a, b, y, x) | _smoothed(b, a, y, x)
    return distant & ~smooth, smooth


def painted(baseline: np.ndarray, changed: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """The baseline in pale grey, with what changed in red and smoothed edges in yellow."""
    out = np.empty((*changed.shape, 3), np.uint8)
    rows = max(1, STRIP // max(1, changed.shape[1]))
    for top in range(0, len(changed), rows):
        grey = 255 + (_weighed(baseline[top : top + rows].astype(np.float64), LUMA) - 255) * SHOWN
        out[top : top + rows] = np.clip(np.floor(grey), 0, 255)[..., None]
    out[changed], out[smooth] = RED, YELLOW
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit pixels (height, width, 3), or (height, width, 1) in grey; each row as its difference to the one above."""
    height, width, n = pixels.shape
    lines = np.empty((height, width * n + 1), np.uint8)
    lines[:, 0] = 2
    flat = pixels.reshape(height, width * n)
    lines[:1, 1:] = flat[:1]
    lines[1:, 1:] = flat[1:] - flat[:-1]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
