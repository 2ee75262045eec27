"""Box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.coerce import to_int


def crop_box(x: Column, y: Column, size: Column, w: Column, h: Column) -> Column:
    """``struct(x0, y0, x1, y1)``; width and height default to the size; NULL when anything is missing or not positive."""
    x, y, size = to_int(x), to_int(y), to_int(size)
    w = F.coalesce(F.nullif(to_int(w), F.lit(0)), size)
    h = F.coalesce(F.nullif(to_int(h), F.lit(0)), size)
    whole = x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0)
    return F.when(whole, F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")))


def tile_box(x: Column, y: Column, size: Column, w: Column, h: Column) -> Column:
    """The materialiser's box: missing origins are 0 and a missing size is 512."""
    size = F.coalesce(F.nullif(to_int(size), F.lit(0)), F.lit(512))
    x0, y0 = F.coalesce(to_int(x), F.lit(0)), F.coalesce(to_int(y), F.lit(0))
    w = F.coalesce(F.nullif(to_int(w), F.lit(0)), size)
    h = F.coalesce(F.nullif(to_int(h), F.lit(0)), size)
    return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))


def clamp_box(box: Column, img_w: Column, img_h: Column) -> Column:
    """The box moved and cut into the image, at least one pixel each way."""
    x0 = F.greatest(F.lit(0), F.least(box["x0"], img_w - 1))
    y0 = F.greatest(F.lit(0), F.least(box["y0"], img_h - 1))
    x1 = F.greatest(x0 + 1, F.least(box["x1"], img_w))
    y1 = F.greatest(y0 + 1, F.least(box["y1"], img_h))
    return F.when(box.isNotNull(), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def pad_box(box: Column, ratio: float, img_w: Column, img_h: Column) -> Column:
    """Grow a box by a share of its extent on each side, inside the frame."""
    pad_y = F.floor((box["y1"] - box["y0"]) * F.lit(ratio)).cast("int")
    pad_x = F.floor((box["x1"] - box["x0"]) * F.lit(ratio)).cast("int")
    return F.struct(
        F.greatest(F.lit(0), box["y0"] - pad_y).alias("y0"),
        F.greatest(F.lit(0), box["x0"] - pad_x).alias("x0"),
        F.least(img_h, box["y1"] + pad_y).alias("y1"),
        F.least(img_w, box["x1"] + pad_x).alias("x1"),
    )


def square_box(box: Column, img_w: Column, img_h: Column) -> Column:
    """Stretch the shorter side to the longer one, inside the frame (the frame may be too small for a square)."""

    def stretch(lo, hi, side, limit):
        start = F.greatest(F.lit(0), lo - F.floor((side - (hi - lo)) / 2).cast("int"))
        end = F.least(limit, start + side)
        return F.when(end - start < side, F.greatest(F.lit(0), end - side)).otherwise(start), end

    h, w = box["y1"] - box["y0"], box["x1"] - box["x0"]
    sx0, sx1 = stretch(box["x0"], box["x1"], h, img_w)
    sy0, sy1 = stretch(box["y0"], box["y1"], w, img_h)
    return F.struct(
        F.when(w > h, sy0).otherwise(box["y0"]).cast("int").alias("y0"),
        F.when(h > w, sx0).otherwise(box["x0"]).cast("int").alias("x0"),
        F.when(w > h, sy1).otherwise(box["y1"]).cast("int").alias("y1"),
        F.when(h > w, sx1).otherwise(box["x1"]).cast("int").alias("x1"),
    )
