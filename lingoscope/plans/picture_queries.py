"""Pictures drawn from pages and compared; every page and every byte of it is drawn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoscope.functions import bands, pixels
from lingoscope.operators.storage import spread
from lingoscope.plans.catalogue import joined, query, table
from lingoscope.sources import snapshots

WIDE = 96
PICTURES = 250  # that a task draws and compares: they are far larger than the pages' file, and a few files hold all pages


@F.pandas_udf(T.BinaryType())
def drawn(text: pd.Series) -> pd.Series:
    """A text's bytes as shades of grey, ``WIDE`` to a line, after a black line."""

    def draw(body: str | None) -> bytes | None:
        if body is None:
            return None
        shades = np.frombuffer(body.encode(), np.uint8)
        page = np.zeros((1 - -len(shades) // WIDE, WIDE), np.uint8)
        page[1:].reshape(-1)[: len(shades)] = shades
        return pixels.encode(page[..., None])

    return text.map(draw)


def page_pictures(spark, sf_dir) -> DataFrame:
    """Each page beside itself with other paragraphs and, for every third, a line more; some were taken otherwise."""
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", PICTURES)
    new = F.regexp_replace("html", "(?i)<p", "<q")
    longer = F.when(F.col("page_id") % 3 == 0, F.concat(new, F.lit("-" * WIDE))).otherwise(new)
    viewport = F.when(F.col("page_id") % 11 == 5, F.lit("390x844")).otherwise(F.lit("1280x800"))
    masks = F.when(F.col("page_id") % 13 == 6, F.array(F.lit(".ad"))).otherwise(F.array(F.lit(".ad"), F.lit("#now")))
    return p.select(
        F.lit("r").alias("run_id"), F.col("page_id").cast("string").alias("url"), drawn(longer).alias("picture"), viewport.alias("viewport"), masks.alias("masks"),
        drawn("html").alias("baseline"), F.lit("1280x800").alias("baseline_viewport"), F.array(F.lit("#now"), F.lit(".ad"), F.lit("#now")).alias("baseline_masks"),
    )


def _boxes(boxes: Column) -> Column:
    return joined(F.transform(boxes, lambda b: F.concat_ws(" ", b["x"], b["y"], b["width"], b["height"])))


@query()
def picture_changes(spark, sf_dir):
    """What changed in the pages' pictures and where, in pixels and as shares of the picture."""
    pairs = page_pictures(spark, sf_dir)
    sizes = pairs.select("url", bands.png_size(F.col("picture")).alias("size"))
    rows = snapshots.compare(pairs).join(sizes, "url")
    shares = bands.region_overlay(F.col("regions"), F.col("size.width"), F.col("size.height"))
    lowest = F.round(F.array_max(F.transform(shares, lambda b: b["top"] + b["height"])), 6)
    return rows.select(
        "url", "comparable", "reason", "changed_pixels", "compared_pixels", "regions_capped", "height_delta", _boxes(F.col("regions")).alias("regions"),
        lowest.alias("lowest"), bands.differs(F.col("comparable"), F.col("changed_pixels"), F.col("compared_pixels")).alias("differs"),
    )


@query()
def picture_overlays(spark, sf_dir):
    """The overlays of the pages' pictures."""
    return snapshots.overlays(page_pictures(spark, sf_dir)).select("url", "overlay")
