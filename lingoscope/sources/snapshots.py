"""Page pictures: decoding PNGs and comparing pairs, a pair at a time inside tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lingoscope.functions import pixels
from lingoscope.schema import MAX_REGIONS, REGION_CELL

RESULT = (
    "run_id string, url string, comparable boolean, reason string, changed_pixels long, compared_pixels long, "
    "regions array<struct<x:int,y:int,width:int,height:int>>, regions_capped boolean, height_delta int"
)
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(png: bytes) -> np.ndarray:
    """RGB pixels of an 8-bit, non-interlaced PNG; transparency shows white."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at + 8 <= len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("an unsupported PNG")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * n + 1)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, n))
    colour = np.repeat(out[..., :1], 3, 2) if n < 3 else out[..., :3]
    if n in (2, 4) and (out[..., -1] < 255).any():
        alpha = out[..., -1:].astype(np.float32) / 255
        colour = colour * alpha + 255 * (1 - alpha)
    return colour


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Bytes of rows (height, width, n) as they were before their filters (0 none, 1 left, 2 up, 3 average, 4 Paeth).

    Stretches of rows with the last two, which look both left and up, are done together
    by diagonals; others a row at a time.
    """
    height, width, n = lines.shape
    if (kinds > 4).any():
        raise ValueError("an unknown filter")
    out = np.zeros((height, width, n), np.uint8)
    above, y = np.zeros((width, n), np.uint8), 0
    both = kinds >= 3
    plain = np.flatnonzero(~both)
    while y < height:
        if both[y]:
            at = np.searchsorted(plain, y)  # few plain rows between two such stretches go with them
            while at < len(plain) and plain[at] - y < DIAGONAL and both[plain[at] : plain[at] + 8].any():
                at += 1
            end = min(int(plain[at]) if at < len(plain) else height, y + DIAGONAL)
            out[y:end] = _by_diagonals(kinds[y:end], lines[y:end], above)
        else:
            end = y + 1
            out[y] = lines[y] if kinds[y] == 0 else lines[y] + above if kinds[y] == 2 else np.cumsum(lines[y], axis=0, dtype=np.uint8)
        y, above = end, out[end - 1]
    return out


DIAGONAL = 4096  # rows that are done together


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels on one diagonal (x + y is the same) need only those of the two before it, so they are done at once."""
    height, width, n = lines.shape
    done = np.zeros((height + 1, width + 1, n), np.int16)  # with the row above and a column of zeros on the left
    done[0, 1:] = above
    flat, given = done.reshape(-1, n), lines.astype(np.int16).reshape(-1, n)
    masks = [(kinds == k)[:, None] for k in (1, 2, 3, 4)]
    for d in range(height + width - 1):
        low, high = max(0, d - width + 1), min(height - 1, d)  # rows that the diagonal crosses
        many = high - low + 1
        # from one row to the next a pixel lies one to the left, so neighbours are an even stride apart
        at = (low + 1) * (width + 1) + d - low + 1
        place = lambda first: slice(first, first + (many - 1) * width + 1, width)  # noqa: B023, E731
        a, b, c = flat[place(at - 1)], flat[place(at - width - 1)], flat[place(at - width - 2)]
        pb, pa = a - c, b - c
        pc = np.abs(pa + pb)
        pa, pb = np.abs(pa), np.abs(pb)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        left, up, average, last = (m[low : high + 1] for m in masks)
        guess = a * left + b * up + ((a + b) >> 1) * average + paeth * last
        first = low * width + d - low
        step = max(1, width - 1)
        flat[place(at)] = (given[first : first + (many - 1) * step + 1 : step] + guess) & 255
    return done[1:, 1:].astype(np.uint8)


def regions(mask: np.ndarray, cell: int = REGION_CELL, most: int = MAX_REGIONS) -> tuple[list[dict], bool]:
    """Boxes around connected cells with changed pixels, largest first, and whether some were left out."""
    rows, columns = -(-mask.shape[0] // cell), -(-mask.shape[1] // cell)
    padded = np.zeros((rows * cell, columns * cell), bool)
    padded[: mask.shape[0], : mask.shape[1]] = mask
    grid = padded.reshape(rows, cell, columns, cell).any(axis=(1, 3))
    label = np.where(grid, np.arange(1, grid.size + 1).reshape(grid.shape), 0)
    while True:  # every cell takes the smallest number among it and its neighbours
        wide = np.pad(np.where(label > 0, label, grid.size + 1), 1, constant_values=grid.size + 1)
        low = np.minimum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        new = np.where(grid, low, 0)
        if (new == label).all():
            break
        label = new
    y, x = np.nonzero(grid)
    names, of = np.unique(label[y, x], return_inverse=True)  # in the order of their first cells
    ends = {}
    for side, fold, at in (("left", np.minimum, x), ("top", np.minimum, y), ("right", np.maximum, x), ("bottom", np.maximum, y)):
        ends[side] = np.full(len(names), grid.size if fold is np.minimum else -1)
        fold.at(ends[side], of, at)
    left, top = ends["left"] * cell, ends["top"] * cell
    width, height = np.minimum((ends["right"] + 1) * cell, mask.shape[1]) - left, np.minimum((ends["bottom"] + 1) * cell, mask.shape[0]) - top
    boxes = [dict(zip(("x", "y", "width", "height"), map(int, box))) for box in zip(left, top, width, height)]
    boxes.sort(key=lambda r: -r["width"] * r["height"])
    return boxes[:most], len(boxes) > most


def _refusal(row) -> str | None:
    if row["picture"] is None or row["baseline"] is None:
        return "missing"
    if row["viewport"] != row["baseline_viewport"]:
        return "viewport_differs"
    if sorted(set(row["masks"])) != sorted(set(row["baseline_masks"])):
        return "masks_differ"
    return None


def _pair(row) -> tuple[str | None, np.ndarray | None, np.ndarray | None]:
    """A refusal, or the pixels of the picture and of its baseline."""
    refused = _refusal(row)
    if refused:
        return refused, None, None
    try:
        a, b = decode(row["picture"]), decode(row["baseline"])
    except (ValueError, zlib.error, struct.error):
        return "unreadable", None, None
    return ("width_differs", None, None) if a.shape[1] != b.shape[1] else (None, a, b)


def _masks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of what both pictures cover: pixels that changed, and smoothed edges.  The count and the overlay both come from here."""
    height = min(len(a), len(b))
    return pixels.compared(b[:height], a[:height])


def _compare(row) -> dict:
    out = dict.fromkeys(("changed_pixels", "compared_pixels", "height_delta"))
    out["reason"], a, b = _pair(row)
    out |= {"comparable": out["reason"] is None, "regions": [], "regions_capped": False}
    if out["reason"]:
        return out
    mask, _ = _masks(a, b)
    boxes, capped = regions(mask)
    return out | {"changed_pixels": int(mask.sum()), "compared_pixels": mask.size, "regions": boxes, "regions_capped": capped, "height_delta": len(a) - len(b)}


def _overlay(row) -> bytes | None:
    refused, a, b = _pair(row)
    if refused:
        return None
    mask, smooth = _masks(a, b)
    return pixels.encode(pixels.painted(b[: len(mask)], mask, smooth))


TOGETHER = 1 << 23  # bytes of answers that leave a task together


def _each(pairs: DataFrame, answer, schema: str) -> DataFrame:
    """A row for each pair, compared one at a time; a task holds one pair's pixels and the answers of a few."""
    told = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                out.append({"run_id": row["run_id"], "url": row["url"], **answer(row)})
                size += len(out[-1].get("overlay") or b"") + 1024
                if size > TOGETHER:
                    yield pa.RecordBatch.from_pylist(out, told)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, told)

    return pairs.mapInArrow(run, schema)


def compare(pairs: DataFrame) -> DataFrame:
    """Compares pictures with their baselines, refusing in a fixed order.

    Pairs: (run_id, url, picture, viewport, masks, baseline, baseline_viewport,
    baseline_masks); only the overlap of two heights is compared.
    """
    return _each(pairs, _compare, RESULT)


def overlays(pairs: DataFrame) -> DataFrame:
    """(run_id, url, overlay): a PNG of what ``compare`` counted, over the baseline; NULL where it refuses."""
    return _each(pairs, lambda row: {"overlay": _overlay(row)}, "run_id string, url string, overlay binary")
