"""Resizing at block level.

Resizing is linear and separable, so every source block adds its own weighted share to the output blocks it
meets; shares are summed after one shuffle.  No task ever holds more than one block and its share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tessella.operators.blocks import BLOCK_FIELDS, PIECE_FIELDS, assemble, block_row, grid_targets, map_blocks, piece, piece_rows, pixels, sum_pieces


def _triangle(x):
    return np.maximum(0.0, 1.0 - np.abs(x))


def _lanczos(x):
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


FILTERS: dict[str, tuple[float, Callable]] = {"triangle": (1.0, _triangle), "lanczos": (3.0, _lanczos)}


@lru_cache(maxsize=64)
def axis_weights(n_in: int, n_out: int, j0: int, j1: int, filt: str = "triangle", antialias: bool = True) -> tuple[int, np.ndarray]:
    """Weights of source cells ``[j0, j1)`` in the output cells they reach: ``(first output, matrix)``.

    The filter widens with the shrink factor; weights of an output cell sum to one over the whole axis.
    """
    reach, fn = FILTERS[filt]
    step = n_in / n_out
    wide = max(step, 1.0) if antialias else 1.0
    support = reach * wide
    lo = max(0, int(np.floor((j0 - support) / step - 0.5)))
    hi = min(n_out, int(np.ceil((j1 + support) / step + 0.5)))
    centre = (np.arange(lo, hi) + 0.5) * step
    first = np.maximum(0, np.floor(centre - support)).astype(np.int64)
    offsets = np.arange(int(np.ceil(2 * support)) + 2)
    cells = first[:, None] + offsets
    full = np.where(cells < n_in, fn((cells + 0.5 - centre[:, None]) / wide), 0.0)
    own = fn((np.arange(j0, j1) + 0.5 - centre[:, None]) / wide)
    return lo, own / full.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1 << 10)
def whole_cells(n_in: int, n_out: int, j0: int, j1: int, first: int, count: int, filt: str = "triangle", antialias: bool = True) -> tuple[int, int]:
    """The run of output cells (relative to ``first``) that draw on source cells ``[j0, j1)`` alone."""
    step = n_in / n_out
    support = FILTERS[filt][0] * (max(step, 1.0) if antialias else 1.0)
    centre = (np.arange(first, first + count) + 0.5) * step
    inside = (np.maximum(0, np.floor(centre - support)) >= j0) & (np.minimum(n_in, np.ceil(centre + support)) <= j1)
    at = np.flatnonzero(inside)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def weigh(arr: np.ndarray, wy: np.ndarray, wx: np.ndarray) -> np.ndarray:
    """Apply row and column weights as two matrix products, the one that shrinks more first."""
    planes = np.atleast_3d(arr).astype(np.float64).transpose(2, 0, 1)
    if wy.shape[0] * wx.shape[1] <= wy.shape[1] * wx.shape[0]:
        out = (wy @ planes) @ wx.T
    else:
        out = wy @ (planes @ wx.T)
    return out[0] if arr.ndim == 2 else np.ascontiguousarray(out.transpose(1, 2, 0))


def nearest_source(n_in: int, n_out: int) -> np.ndarray:
    """Source cell of each output cell."""
    return ((2 * np.arange(n_out) + 1) * n_in) // (2 * n_out)


def _spread(out: np.ndarray, y0: int, x0: int, canvas: tuple[int, int], block: int, nch: int):
    """Split a placed rectangle over the output block grid."""
    targets, parts = [], []
    for by, bx, ty0, tx0, ty1, tx1 in grid_targets(canvas[0], canvas[1], block, y0, x0, y0 + out.shape[0], x0 + out.shape[1]):
        ya, yb, xa, xb = max(ty0, y0), min(ty1, y0 + out.shape[0]), max(tx0, x0), min(tx1, x0 + out.shape[1])
        if ya < yb and xa < xb:
            targets.append((by, bx, ty0, tx0, ty1 - ty0, tx1 - tx0, canvas[0], canvas[1], nch))
            parts.append(piece(ya, xa, np.ascontiguousarray(out[ya - y0 : yb - y0, xa - x0 : xb - x0])))
    return targets, parts


def resize_nearest(blocks: DataFrame, block: int, size: Callable[[dict], tuple[int, int]], dtype=np.uint8,
                   keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Nearest-neighbour resize; ``size(block)`` gives the output ``(height, width)``."""

    def kernel(b):
        out_h, out_w = size(b)
        src_y, src_x = nearest_source(b["img_h"], out_h), nearest_source(b["img_w"], out_w)
        ya, yb = np.searchsorted(src_y, [b["y0"], b["y0"] + b["h"]])
        xa, xb = np.searchsorted(src_x, [b["x0"], b["x0"] + b["w"]])
        if ya >= yb or xa >= xb:
            return None
        part = pixels(b, dtype)[np.ix_(src_y[ya:yb] - b["y0"], src_x[xa:xb] - b["x0"])]
        return piece_rows(*_spread(part, int(ya), int(xa), (out_h, out_w), block, b["nch"]))

    return assemble(map_blocks(blocks, kernel, PIECE_FIELDS, keys), dtype, keys=keys)


def to_levels(v: np.ndarray) -> np.ndarray:
    """Nearest 8-bit level, halves up."""
    return np.clip(np.floor(np.round(v, 6) + 0.5), 0, 255).astype(np.uint8)


def resize_linear(blocks: DataFrame, block: int, size: Callable[[dict], tuple[int, int]], filt: str = "triangle",
                  antialias: bool = True, dtype=np.uint8, finish=to_levels, place: Callable[[dict], tuple[int, int, int, int]] | None = None,
                  keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Weighted resize to ``size(block)``; ``place(block)`` optionally sets it on a canvas: ``(y, x, height, width)``."""

    def kernel(b):
        out_h, out_w = size(b)
        top, left, canvas_h, canvas_w = place(b) if place else (0, 0, out_h, out_w)
        iy, wy = axis_weights(b["img_h"], out_h, b["y0"], b["y0"] + b["h"], filt, antialias)
        ix, wx = axis_weights(b["img_w"], out_w, b["x0"], b["x0"] + b["w"], filt, antialias)
        out = weigh(pixels(b, dtype), wy, wx)
        areas = [(0, 0, out)]
        if finish is to_levels:
            # cells no other block adds to are final: they travel as bytes, only the border as unfinished sums
            ya, yb = whole_cells(b["img_h"], out_h, b["y0"], b["y0"] + b["h"], iy, len(wy), filt, antialias)
            xa, xb = whole_cells(b["img_w"], out_w, b["x0"], b["x0"] + b["w"], ix, len(wx), filt, antialias)
            if ya < yb and xa < xb:
                areas = [(ya, xa, to_levels(out[ya:yb, xa:xb])), (0, 0, out[:ya]), (yb, 0, out[yb:]), (ya, 0, out[ya:yb, :xa]), (ya, xb, out[ya:yb, xb:])]
        targets, parts = [], []
        for dy, dx, area in areas:
            if area.size:
                some, cut = _spread(area, iy + top + dy, ix + left + dx, (canvas_h, canvas_w), block, b["nch"])
                targets, parts = targets + some, parts + cut
        if place and b["by"] == 0 and b["bx"] == 0:
            # one empty piece per canvas block, so that blocks made of padding only exist too
            for by, bx, ty0, tx0, ty1, tx1 in grid_targets(canvas_h, canvas_w, block, 0, 0, canvas_h, canvas_w):
                targets.append((by, bx, ty0, tx0, ty1 - ty0, tx1 - tx0, canvas_h, canvas_w, b["nch"]))
                parts.append(piece(ty0, tx0, np.empty((0, 0))))
        return piece_rows(targets, parts)

    shares = map_blocks(blocks, kernel, PIECE_FIELDS, keys, merge=sum_pieces())
    return assemble(shares, np.float64, add=True, keys=keys, finish=finish)


def letterbox_geometry(img_h: int, img_w: int, size: int) -> tuple[int, int, int, int]:
    """``(new_h, new_w, y0, x0)``: the long side scaled to ``size``, centred."""
    scale = size / max(img_h, img_w)
    new_h, new_w = max(1, round(img_h * scale)), max(1, round(img_w * scale))
    return new_h, new_w, (size - new_h) // 2, (size - new_w) // 2


def letterbox(blocks: DataFrame, block: int, size: int) -> DataFrame:
    """Scaled to the long side and centred on a black square."""

    def new_size(b):
        return letterbox_geometry(b["img_h"], b["img_w"], size)[:2]

    def place(b):
        return (*letterbox_geometry(b["img_h"], b["img_w"], size)[2:], size, size)

    return resize_linear(blocks, block, new_size, place=place)


# Channel mean and deviation of the classifier's input
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def normalise_channels(blocks: DataFrame) -> DataFrame:
    """0..255 pixels to standardised doubles."""
    def kernel(b):
        return block_row(b, b["y0"], b["x0"], (pixels(b) / 255.0 - CHANNEL_MEAN) / CHANNEL_STD)

    return map_blocks(blocks, kernel, BLOCK_FIELDS)


def resize_crops(crops: DataFrame, height: int, width: int, filt: str = "triangle", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Cropped tiles, each whole in its row, resized to single-block images of their own: no share of them meets another."""

    def kernel(b):
        _, wy = axis_weights(b["h"], height, 0, b["h"], filt)
        _, wx = axis_weights(b["w"], width, 0, b["w"], filt)
        out = to_levels(weigh(pixels(b), wy, wx))
        return block_row({"by": 0, "bx": 0, "img_h": height, "img_w": width}, 0, 0, out)

    return map_blocks(crops, kernel, BLOCK_FIELDS, keys)
