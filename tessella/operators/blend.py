"""Pasting edited patches back."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocks import BLOCK_FIELDS, PIECE_FIELDS, assemble, block_row, map_blocks, piece_rows, pixels, spread_over_blocks, sum_pieces
from tessella.operators.masks import gauss
from tessella.operators.resample import _spread, axis_weights, to_levels, weigh


def axis_profile(n: int, lo: int, hi: int, radius: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Blend weight along one axis for cells ``[start, stop)``: a Gaussian-smoothed box ``[lo, hi)``, mirrored at
    the frame and cut to the box plus the radius.  A smoothed rectangle is the product of its two profiles."""
    at = np.arange(start, n if stop is None else stop)
    if radius <= 0:
        return ((at >= lo) & (at < hi)).astype(np.float64)
    weights = gauss(radius / 2.0)
    r = len(weights) // 2
    cells = (at[:, None] + np.arange(-r, r + 1)) % (2 * n)
    cells = np.where(cells < n, cells, 2 * n - 1 - cells)
    smooth = ((cells >= lo) & (cells < hi)) @ weights
    return np.where((at >= lo - radius) & (at < hi + radius), smooth, 0.0)


@lru_cache(maxsize=1 << 10)
def _block_profile(*cells: int) -> np.ndarray:
    """``axis_profile`` of the cells of a block, which are few."""
    return axis_profile(*cells)


def feather_profiles(boxes: DataFrame, radius: int = 16) -> DataFrame:
    """Blend weights of a box as two short relations: ``(image_id, axis, i, weight)``."""

    def kernel(b):
        y = axis_profile(b["img_h"], b["y0b"], b["y1b"], radius)
        x = axis_profile(b["img_w"], b["x0b"], b["x1b"], radius)
        return {
            "axis": ["y"] * len(y) + ["x"] * len(x),
            "i": np.concatenate([np.arange(len(y)), np.arange(len(x))]).astype(np.int32),
            "weight": np.concatenate([y, x]),
        }

    return map_blocks(boxes, kernel, "axis string, i int, weight double")


def place_patches(patches: DataFrame, boxes: DataFrame, block: int) -> DataFrame:
    """Edited patches resized to their box and cut along the source image's block grid.

    ``patches`` are block images in patch space; ``boxes`` gives the window in the source image.
    """
    window = boxes.select("image_id", F.col("img_h").alias("fh"), F.col("img_w").alias("fw"), "y0b", "x0b", "y1b", "x1b")
    cells = patches.select("image_id", "by", "bx", "img_h", "img_w").join(window, "image_id")
    # the window joins the small key columns; pixel bytes meet it on the full block key
    placed = patches.join(cells.drop("img_h", "img_w"), ["image_id", "by", "bx"])

    def kernel(b):

        out_h, out_w = b["y1b"] - b["y0b"], b["x1b"] - b["x0b"]
        iy, wy = axis_weights(b["img_h"], out_h, b["y0"], b["y0"] + b["h"])
        ix, wx = axis_weights(b["img_w"], out_w, b["x0"], b["x0"] + b["w"])
        out = weigh(pixels(b), wy, wx)
        return piece_rows(*_spread(out, iy + b["y0b"], ix + b["x0b"], (b["fh"], b["fw"]), block, b["nch"]))

    return assemble(map_blocks(placed, kernel, PIECE_FIELDS, merge=sum_pieces()), np.float64, add=True, finish=to_levels)


def paste_back(original: DataFrame, edited: DataFrame, boxes: DataFrame, block: int, radius: int = 16) -> DataFrame:
    """Blend edited blocks into the original inside the box; everything else passes through untouched.

    All three inputs meet on the full block key: the box is spread over the blocks it touches first.
    """
    key = ["image_id", "by", "bx"]
    window = spread_over_blocks(boxes.select("image_id", "y0b", "x0b", "y1b", "x1b"), block, "y0b", "x0b", "y1b", "x1b")
    met = original.join(window, key, "left").join(edited.select(*key, F.col("data").alias("edit")), key, "left")

    def kernel(b):
        arr = pixels(b)
        if b["y0b"] is None or b["edit"] is None:
            return block_row(b, b["y0"], b["x0"], arr)
        rows, cols = np.arange(b["y0"], b["y0"] + b["h"]), np.arange(b["x0"], b["x0"] + b["w"])
        wy = _block_profile(b["img_h"], b["y0b"], b["y1b"], radius, b["y0"], b["y0"] + b["h"])
        wx = _block_profile(b["img_w"], b["x0b"], b["x1b"], radius, b["x0"], b["x0"] + b["w"])
        inside = ((rows >= b["y0b"]) & (rows < b["y1b"]))[:, None] & ((cols >= b["x0b"]) & (cols < b["x1b"]))[None, :]
        weight = (wy[:, None] * wx[None, :])[:, :, None]
        mixed = arr * (1.0 - weight) + pixels(b, data="edit") * weight
        out = np.where(inside[:, :, None], np.floor(np.round(mixed, 6)), arr).astype(np.uint8)
        return block_row(b, b["y0"], b["x0"], out)

    return map_blocks(met, kernel, BLOCK_FIELDS)
