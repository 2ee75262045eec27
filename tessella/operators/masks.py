"""Mask shaping: dilation, soft edges, tissue, overlays and random brush masks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocks import BLOCK_FIELDS, block_row, map_blocks, pixels, spread_over_blocks, trim_rim, with_rim


def _frame_pad(b: dict, arr: np.ndarray, block: int, rim: int, mode: str) -> np.ndarray:
    """Complete a grown block to the full rim where the frame ends."""
    y0, x0 = b["by"] * block, b["bx"] * block
    y1, x1 = min(b["img_h"], y0 + block), min(b["img_w"], x0 + block)
    grow = [(rim - (y0 - b["y0"]), rim - (b["y0"] + b["h"] - y1)), (rim - (x0 - b["x0"]), rim - (b["x0"] + b["w"] - x1))]
    return np.pad(arr, grow, mode=mode)


def ellipse_offsets(size: int) -> list[tuple[int, int]]:
    """Pixel offsets of an elliptic structuring element of the given odd or even size."""
    r = size // 2
    out = []
    for i in range(size):
        dy = i - r
        half = int(round(r * np.sqrt(max(0.0, 1.0 - dy * dy / (r * r))))) if r else 0
        out += [(dy, dx) for dx in range(-half, min(half, size - 1 - r) + 1)]
    return out


def dilate(mask_blocks: DataFrame, block: int, radius: float = 0, offsets: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Maximum over a square of the rounded radius, or over explicit offsets."""
    r = max(0, int(round(float(radius)))) if offsets is None else max([0, *[max(abs(a), abs(c)) for a, c in offsets]])
    if r == 0:
        return mask_blocks

    def kernel(b):
        arr = _frame_pad(b, pixels(b), block, r, "constant")
        h, w = arr.shape[0] - 2 * r, arr.shape[1] - 2 * r
        if offsets is None:
            rows = np.max([arr[:, d : d + w] for d in range(2 * r + 1)], axis=0)
            out = np.max([rows[d : d + h] for d in range(2 * r + 1)], axis=0)
        else:
            # a mask pixel spreads to its offsets, so each pixel looks back along them
            out = np.max([arr[r - dy : r - dy + h, r - dx : r - dx + w] for dy, dx in offsets], axis=0)
        return block_row(b, b["by"] * block, b["bx"] * block, out)

    return map_blocks(with_rim(mask_blocks, block, r), kernel, BLOCK_FIELDS)


@lru_cache(maxsize=64)
def gauss(sigma: float, reach: float = 4.0) -> np.ndarray:
    """Normalised Gaussian weights out to ``reach`` standard deviations."""
    r = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def soften(mask_blocks: DataFrame, block: int, sigma: float, strength: float = 1.0) -> DataFrame:
    """Gaussian blur (edge pixels repeat beyond the frame), then a strength factor, clipped to 0..255."""
    weights = gauss(sigma) if sigma > 0 else np.ones(1)
    r = len(weights) // 2
    grown = with_rim(mask_blocks, block, r) if r else mask_blocks

    def kernel(b):
        arr = _frame_pad(b, pixels(b), block, r, "edge").astype(np.float64)
        h, w = arr.shape[0] - 2 * r, arr.shape[1] - 2 * r
        rows = sum(weights[d] * arr[:, d : d + w] for d in range(2 * r + 1))
        out = sum(weights[d] * rows[d : d + h] for d in range(2 * r + 1))
        level = np.floor(np.round(out, 6) + 0.5)
        if abs(strength - 1.0) > 1e-6:
            level = np.floor(np.round(np.clip(level * strength, 0, 255), 6))
        return block_row(b, b["by"] * block, b["bx"] * block, level.astype(np.uint8))

    return map_blocks(grown, kernel, BLOCK_FIELDS)


def tissue(rgb_blocks: DataFrame, white_at: int = 235, any_colour: bool = False) -> DataFrame:
    """Tissue masks (0 / 255): any channel below the white threshold, or any channel not zero."""

    def kernel(b):
        arr = pixels(b)
        on = (arr != 0).any(axis=2) if any_colour else (arr < white_at).any(axis=2)
        return block_row(b, b["y0"], b["x0"], (on * 255).astype(np.uint8))

    return map_blocks(rgb_blocks, kernel, BLOCK_FIELDS)


def tint(rgb_blocks: DataFrame, mask_blocks: DataFrame, alpha: float = 0.40) -> DataFrame:
    """Red overlay where the mask is on; both inputs share the block grid."""
    pairs = rgb_blocks.join(mask_blocks.select("image_id", "by", "bx", F.col("data").alias("mask")), ["image_id", "by", "bx"])

    def kernel(b):
        rgb = pixels(b).astype(np.float64)
        m = np.frombuffer(b["mask"], dtype=np.uint8).reshape(b["h"], b["w"], 1) / 255.0
        out = rgb * (1.0 - alpha * m) + np.array([255.0, 0.0, 0.0]) * alpha * m
        return block_row(b, b["y0"], b["x0"], np.floor(np.round(np.clip(out, 0, 255), 6)).astype(np.uint8))

    return map_blocks(pairs, kernel, BLOCK_FIELDS)


@dataclass(frozen=True)
class Brush:
    """Parameters of random brush masks."""

    seed: int = 222
    attempts: int = 20
    min_area: float = 0.12
    max_area: float = 0.40
    min_strokes: int = 1
    max_strokes: int = 4
    min_vertices: int = 3
    max_vertices: int = 8
    min_px: int = 24
    max_px: int = 128
    tissue_overlap: float = 0.6


def _draw(p: Brush, key, attempt: int, *what) -> float:
    """A number in [0, 1) that depends only on its name, not on any shared generator."""
    text = "|".join(str(v) for v in (p.seed, key, attempt, *what))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def _pick(u: float, lo: int, hi: int) -> int:
    return lo + int(u * (hi - lo + 1))


def brush_strokes(p: Brush, key, attempt: int, w: int, h: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Strokes of one attempt: ``(radius, vertices)``; vertices walk at random and stay inside the frame."""
    strokes = []
    for s in range(_pick(_draw(p, key, attempt, "n"), p.min_strokes, p.max_strokes)):
        count = _pick(_draw(p, key, attempt, s, "v"), p.min_vertices, p.max_vertices)
        x, y = int(_draw(p, key, attempt, s, 0, "x") * w), int(_draw(p, key, attempt, s, 0, "y") * h)
        line = [(x, y)]
        for v in range(1, count):
            x = min(w - 1, max(0, x + _pick(_draw(p, key, attempt, s, v, "x"), -(w // 3), w // 3)))
            y = min(h - 1, max(0, y + _pick(_draw(p, key, attempt, s, v, "y"), -(h // 3), h // 3)))
            line.append((x, y))
        strokes.append((max(1, _pick(_draw(p, key, attempt, s, "w"), p.min_px, p.max_px) // 2), line))
    return strokes


def paint_strokes(strokes, w: int, h: int) -> np.ndarray:
    """Pixels within the radius of any segment; whole-number arithmetic throughout."""
    yy, xx = np.mgrid[0:h, 0:w].astype(np.int64)
    on = np.zeros((h, w), dtype=bool)
    for r, line in strokes:
        for (ax, ay), (bx, by) in zip(line, line[1:] or line):
            dx, dy = bx - ax, by - ay
            px, py = xx - ax, yy - ay
            length, along = dx * dx + dy * dy, px * dx + py * dy
            cross = px * dy - py * dx
            inside = (along > 0) & (along < length) & (cross * cross <= r * r * length)
            ends = (px * px + py * py <= r * r) | ((xx - bx) ** 2 + (yy - by) ** 2 <= r * r)
            on |= inside | ends
    return on


def centre_ellipse(w: int, h: int) -> np.ndarray:
    """Fallback mask: a centred ellipse of a sixth of the frame (at least 8 pixels) each way."""
    rx, ry = max(8, w // 6), max(8, h // 6)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.int64)
    return (xx - w // 2) ** 2 * ry**2 + (yy - h // 2) ** 2 * rx**2 <= (rx * ry) ** 2


def brush_attempts(tiles: DataFrame, p: Brush, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Every attempt of every tile with its area; tiles are single-block images (bounded size)."""

    def kernel(b):
        name = "|".join(str(b[k]) for k in keys)
        area = [int(paint_strokes(brush_strokes(p, name, a, b["w"], b["h"]), b["w"], b["h"]).sum()) for a in range(p.attempts)]
        return {"attempt": list(range(p.attempts)), "n_on": area, "n_px": [b["w"] * b["h"]] * p.attempts}

    return map_blocks(tiles, kernel, "attempt int, n_on bigint, n_px bigint", keys)


def random_masks(tissue_tiles: DataFrame, p: Brush, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One mask per tile: the first attempt whose area lies in the band and that covers enough tissue, else the
    centred ellipse.

    Input and output are single-block tiles. Draws depend on (seed, tile, attempt) only, so the result does not
    depend on partitioning or listing order, and later attempts are not computed once one is accepted.
    """

    def kernel(b):
        name = "|".join(str(b[k]) for k in keys)
        w, h = b["w"], b["h"]
        floor = pixels(b) > 0
        for attempt in range(max(1, p.attempts)):
            on = paint_strokes(brush_strokes(p, name, attempt, w, h), w, h)
            n = int(on.sum())
            if n == 0 or not p.min_area <= n / (w * h) <= p.max_area:
                continue
            if p.tissue_overlap > 0 and int((on & floor).sum()) / n < p.tissue_overlap:
                continue
            break
        else:
            on, attempt = centre_ellipse(w, h), -1
        row = block_row(b, b["y0"], b["x0"], (on * 255).astype(np.uint8))
        return {**row, "attempt": [attempt], "n_on": [int(on.sum())], "fallback": [attempt < 0]}

    return map_blocks(tissue_tiles, kernel, BLOCK_FIELDS + ", attempt int, n_on bigint, fallback boolean", keys)
