"""Class maps, regions of interest and their boxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import boxes
from tessella.operators.blocks import BLOCK_FIELDS, block_row, map_blocks, pixels

# Mask colour (red, green, blue) -> class id
PALETTE: dict[tuple[int, int, int], int] = {
    (0, 0, 0): 0,
    (224, 224, 224): 1,
    (96, 96, 96): 2,
    (150, 150, 0): 3,
    (127, 255, 255): 4,
    (255, 156, 0): 5,
    (255, 0, 255): 6,
    (0, 255, 0): 7,
    (0, 156, 255): 8,
    (127, 96, 255): 9,
    (112, 48, 160): 10,
    (0, 0, 128): 11,
}


def decode_palette(rgb_blocks: DataFrame, palette: Mapping[tuple[int, int, int], int] = PALETTE, unknown: int = -1) -> DataFrame:
    """Colour masks to class ids (int8). Pairing keeps unknown colours as -1; regions of interest use 0."""
    codes = np.array([r * 65536 + g * 256 + b for r, g, b in palette], dtype=np.int64)
    order = np.argsort(codes)
    codes, ids = codes[order], np.array(list(palette.values()), dtype=np.int8)[order]

    def kernel(b):
        arr = pixels(b).astype(np.int64)
        packed = arr[:, :, 0] * 65536 + arr[:, :, 1] * 256 + arr[:, :, 2]
        at = np.minimum(np.searchsorted(codes, packed), len(codes) - 1)
        cid = np.where(codes[at] == packed, ids[at], unknown).astype(np.int8)
        return block_row(b, b["y0"], b["x0"], cid)

    return map_blocks(rgb_blocks, kernel, BLOCK_FIELDS)


def class_counts(class_blocks: DataFrame) -> DataFrame:
    """Pixels per image and class: ``(image_id, cid, n)``."""

    def kernel(b):
        cid, n = np.unique(pixels(b, np.int8), return_counts=True)
        return {"cid": cid.astype(np.int32), "n": n.astype(np.int64)}

    return map_blocks(class_blocks, kernel, "cid int, n bigint").groupBy("image_id", "cid").agg(F.sum("n").alias("n"))


def image_classes(counts: DataFrame) -> DataFrame:
    """Classes present (sorted, unknown left out) and the dominant class that is not background (0 if none;
    equal areas go to the smaller id)."""
    real = F.when(F.col("cid") > 0, F.col("cid"))
    return counts.groupBy("image_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("cid") >= 0, F.col("cid")))).alias("classes_present"),
        F.coalesce(F.max_by(real, F.when(F.col("cid") > 0, F.struct("n", -F.col("cid")))), F.lit(0)).alias("dominant_class_id"),
    )


def region(cid: np.ndarray, include: Sequence[int] | None, exclude: Sequence[int]) -> np.ndarray:
    """Foreground: any class but background, or the included ones; never the excluded ones."""
    keep = (cid != 0) if include is None else np.isin(cid, list(include))
    return keep & ~np.isin(cid, list(exclude)) if exclude else keep


def roi_blocks(class_blocks: DataFrame, include: Sequence[int] | None = None, exclude: Sequence[int] = ()) -> DataFrame:
    """Region masks (0 / 255) from class ids; unknown colours count as background."""
    if include is not None and not include:
        raise ValueError("including classes needs at least one class id")

    def kernel(b):
        cid = np.maximum(pixels(b, np.int8), 0)
        return block_row(b, b["y0"], b["x0"], (region(cid, include, exclude) * 255).astype(np.uint8))

    return map_blocks(class_blocks, kernel, BLOCK_FIELDS)


def mask_extent(mask_blocks: DataFrame) -> DataFrame:
    """Per image: frame, foreground count and tight foreground box (NULL for an empty mask)."""

    def kernel(b):
        on = pixels(b) > 0
        ys, xs = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
        some = len(ys) > 0
        return {
            "img_h": [b["img_h"]], "img_w": [b["img_w"]], "n": [int(on.sum())],
            "y0": [int(ys[0]) + b["y0"] if some else None], "x0": [int(xs[0]) + b["x0"] if some else None],
            "y1": [int(ys[-1]) + 1 + b["y0"] if some else None], "x1": [int(xs[-1]) + 1 + b["x0"] if some else None],
        }

    shares = map_blocks(mask_blocks, kernel, "img_h int, img_w int, n bigint, y0 int, x0 int, y1 int, x1 int")
    return shares.groupBy("image_id").agg(
        F.max("img_h").alias("img_h"), F.max("img_w").alias("img_w"), F.sum("n").alias("n_on"),
        F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"),
    )


def mask_boxes(mask_blocks: DataFrame, padding: float = 0.15, square: bool = False) -> DataFrame:
    """Padded box of the foreground (whole frame for an empty mask), squared on request: ``image_id, img_h, img_w, box``."""
    ext = mask_extent(mask_blocks)
    tight = F.struct("y0", "x0", "y1", "x1")
    padded = boxes.pad_box(tight, padding, F.col("img_w"), F.col("img_h"))
    frame = F.struct(F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.col("img_h").alias("y1"), F.col("img_w").alias("x1"))
    out = ext.select("image_id", "img_h", "img_w", F.when(F.col("n_on") > 0, padded).otherwise(frame).alias("box"))
    return out.withColumn("box", boxes.square_box(F.col("box"), F.col("img_w"), F.col("img_h"))) if square else out


def roi_coverage(mask_blocks: DataFrame) -> DataFrame:
    """Share of foreground per image."""
    ext = mask_extent(mask_blocks)
    return ext.select("image_id", (F.col("n_on") / (F.col("img_h").cast("bigint") * F.col("img_w"))).alias("coverage"))


def patch_geometry(boxed: DataFrame, target_size: int) -> DataFrame:
    """Patch metadata columns from a box."""
    b = F.col("box")
    return boxed.select(
        "*",
        b["y0"].alias("bbox_y_min"), b["x0"].alias("bbox_x_min"), b["y1"].alias("bbox_y_max"), b["x1"].alias("bbox_x_max"),
        (b["y1"] - b["y0"]).alias("bbox_height"), (b["x1"] - b["x0"]).alias("bbox_width"), F.lit(target_size).alias("target_size"),
        (F.lit(float(target_size)) / F.greatest(b["x1"] - b["x0"], F.lit(1))).alias("scale_x"),
        (F.lit(float(target_size)) / F.greatest(b["y1"] - b["y0"], F.lit(1))).alias("scale_y"),
        F.lit(0).alias("seed_placeholder"),
    ).drop("box")
