"""Image fixtures derived from the whole ``part`` table: one slide per part, pixels by integer formulas.

Every formula exists twice: in Spark (columns for slides, numpy for pixel blocks) and in SQL.
One slide in 250 is large, so that images differ in size by a factor of about a hundred.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.checks.registry import table
from tessella.operators.blocks import BLOCK_FIELDS, axes, map_blocks
from tessella.operators.roi import PALETTE
from tessella.plans.mining import Mining

BLOCK = 64
TILE, STRIDE = 24, 8
MINING = Mining(size=TILE, stride=STRIDE, per_image=6, max_white=0.30, seed=222)

SLIDES_SQL = """
slides AS (
  SELECT k, w, h, CASE WHEN k % 10 = 7 THEN concat('scan', CAST(k AS VARCHAR))
    ELSE concat('MD', CAST(20 + v % 6 AS VARCHAR), '-', lpad(CAST(v AS VARCHAR), 7, '0'), '(',
      substr('ABCD', CAST(v % 4 + 1 AS INT), 1), CAST(1 + v % 3 AS VARCHAR), '-',
      CASE WHEN k % 10 = 9 THEN '12' ELSE CAST(1 + k % 4 AS VARCHAR) END, ')') END AS stem
  FROM (SELECT CAST(p_partkey AS INT) AS k, CAST(p_partkey // 4 AS INT) AS v,
    CAST(CASE WHEN p_partkey % 250 = 3 THEN 308 ELSE 20 + (p_partkey % 5) * 8 END AS INT) AS w,
    CAST(CASE WHEN p_partkey % 250 = 3 THEN 204 ELSE 24 + (p_partkey % 4) * 6 END AS INT) AS h FROM part) q
),
masks AS (SELECT k, stem, CASE WHEN k % 17 = 3 THEN w + 1 ELSE w END AS w, h FROM slides WHERE k % 13 <> 5)
"""

PIXELS_SQL = SLIDES_SQL + """,
pixels AS (
  SELECT k, x, y, w, h, cid, white,
    CAST(CASE WHEN white THEN 240 + (x + y) % 3 ELSE (x * 7 + y * 13 + k * 3) % 200 END AS INT) AS r,
    CAST(CASE WHEN white THEN 241 ELSE (x * 11 + y * 5 + k * 17) % 200 END AS INT) AS g,
    CAST(CASE WHEN white THEN 242 ELSE (x * 3 + y * 19 + k * 29) % 200 END AS INT) AS b
  FROM (SELECT k, x, y, w, h, (x // 16 + y // 16 + k) % 5 < k % 3 AS white,
      CAST(CASE WHEN k % 37 = 0 THEN 0
           WHEN (x * y + k) % 97 = 0 THEN -1
           WHEN (x // 12 + y // 10 + k) % 4 < k % 4 THEN 0
           ELSE 1 + ((x // 8) * 3 + (y // 8) * 5 + k * 7) % 11 END AS INT) AS cid
    FROM slides, unnest(range(0, w)) AS ux(x), unnest(range(0, h)) AS uy(y)) q
)
"""

EDITED_SQL = PIXELS_SQL + """,
boxes AS (
  SELECT k, w, h, CASE WHEN k % 8 = 0 THEN 0 ELSE 5 END AS y0, CASE WHEN k % 8 = 0 THEN 0 ELSE 4 END AS x0,
    CASE WHEN k % 8 = 0 THEN h ELSE h - 7 END AS y1, CASE WHEN k % 8 = 0 THEN w ELSE w - 6 END AS x1 FROM slides
),
edited AS (
  SELECT p.*, y0, x0, y1, x1, inside, r + least(255 - r, step) AS er, g + least(255 - g, step) AS eg, b + least(255 - b, step) AS eb
  FROM (SELECT p.*, bx.y0, bx.x0, bx.y1, bx.x1,
      (y >= y0 AND y < y1 AND x >= x0 AND x < x1) AS inside,
      CASE WHEN y >= y0 AND y < y1 AND x >= x0 AND x < x1 THEN (x * y) % 60
           WHEN (x + y + p.k) % 37 = 0 THEN 1 ELSE 0 END AS step
    FROM pixels p JOIN boxes bx USING (k)) p
)
"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, w, h, stem``: one slide per part."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        key.cast("int").alias("k"),
        F.floor(key / 4).cast("int").alias("v"),
        F.when(key % 250 == 3, 308).otherwise(20 + (key % 5) * 8).cast("int").alias("w"),
        F.when(key % 250 == 3, 204).otherwise(24 + (key % 4) * 6).cast("int").alias("h"),
    )
    stem = F.expr(
        "CASE WHEN k % 10 = 7 THEN concat('scan', k) ELSE concat('MD', 20 + v % 6, '-', lpad(cast(v AS string), 7, '0'), '(',"
        " substr('ABCD', v % 4 + 1, 1), 1 + v % 3, '-', CASE WHEN k % 10 = 9 THEN '12' ELSE cast(1 + k % 4 AS string) END, ')') END"
    )
    return part.select("k", "w", "h", stem.alias("stem"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask listing: one slide in 13 has none, one in 17 has a mask one pixel wider."""
    return (
        slides(spark, sf_dir)
        .where("k % 13 <> 5")
        .select("k", "stem", F.when(F.expr("k % 17 = 3"), F.col("w") + 1).otherwise(F.col("w")).alias("w"), "h")
    )


def _grid(b: dict) -> tuple[np.ndarray, np.ndarray, int]:
    yy, xx = axes(b)
    return yy.astype(np.int32), xx.astype(np.int32), b["image_id"]


# The slide's own term is reduced first, which changes no remainder and keeps sums small.
def _classes(b: dict) -> np.ndarray:
    y, x, k = _grid(b)
    if k % 37 == 0:
        return np.zeros((b["h"], b["w"]), dtype=np.int8)
    cid = 1 + ((x // 8) * 3 + ((y // 8) * 5 + k * 7 % 11)) % 11
    cid = np.where((x // 12 + (y // 10 + k % 4)) % 4 < k % 4, 0, cid)
    return np.where((x * y + k % 97) % 97 == 0, -1, cid).astype(np.int8)


def _rgb(b: dict) -> np.ndarray:
    y, x, k = _grid(b)
    out = np.empty((b["h"], b["w"], 3), np.uint8)
    for c, (across, down, own) in enumerate(((7, 13, 3), (11, 5, 17), (3, 19, 29))):
        out[:, :, c] = (x * across + (y * down + k * own % 200)) % 200
    white = (x // 16 + (y // 16 + k % 5)) % 5 < k % 3
    if white.any():
        np.copyto(out[:, :, 0], (240 + (x + y) % 3).astype(np.uint8), where=white)
        out[:, :, 1][white], out[:, :, 2][white] = 241, 242
    return out


def bbox_of(w: int, h: int, k: int) -> tuple[int, int, int, int]:
    return (0, 0, h, w) if k % 8 == 0 else (5, 4, h - 7, w - 6)


def _edited(b: dict) -> np.ndarray:
    y, x, k = _grid(b)
    y0, x0, y1, x1 = bbox_of(b["img_w"], b["img_h"], k)
    inside = (y >= y0) & (y < y1) & (x >= x0) & (x < x1)
    step = np.where(inside, (x * y) % 60, (x + (y + k % 37)) % 37 == 0).astype(np.uint8)[:, :, None]
    before = _rgb(b)
    return before + np.minimum(255 - before, step)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit windows per slide; the whole frame for one slide in eight."""
    whole = F.expr("k % 8 = 0")
    return slides(spark, sf_dir).select(
        F.col("k").alias("image_id"),
        F.col("w").alias("img_w"),
        F.col("h").alias("img_h"),
        F.when(whole, 0).otherwise(5).alias("y0b"),
        F.when(whole, 0).otherwise(4).alias("x0b"),
        F.when(whole, F.col("h")).otherwise(F.col("h") - 7).alias("y1b"),
        F.when(whole, F.col("w")).otherwise(F.col("w") - 6).alias("x1b"),
    )


def _blocks(spark: SparkSession, sf_dir: str, paint, nch: int, block: int) -> DataFrame:
    from tessella.operators.blocks import spread_over_blocks

    frames = slides(spark, sf_dir).select(F.col("k").alias("image_id"), F.col("h").alias("img_h"), F.col("w").alias("img_w"))
    # painting is the costly part of the fixture: spread the cells before it
    cells = spread_over_blocks(frames, block).repartition(2 * spark.sparkContext.defaultParallelism, "image_id", "by", "bx")

    def kernel(c):
        y0, x0 = c["by"] * block, c["bx"] * block
        h, w = min(block, c["img_h"] - y0), min(block, c["img_w"] - x0)
        data = paint({**c, "y0": y0, "x0": x0, "h": h, "w": w}).tobytes()
        return {"by": [c["by"]], "bx": [c["bx"]], "y0": [y0], "x0": [x0], "h": [h], "w": [w],
                "img_h": [c["img_h"]], "img_w": [c["img_w"]], "nch": [nch], "data": [data]}

    return map_blocks(cells, kernel, BLOCK_FIELDS)


def class_blocks(spark, sf_dir, block: int = BLOCK) -> DataFrame:
    """Class ids (int8, -1 = unknown colour)."""
    return _blocks(spark, sf_dir, _classes, 1, block)


def mask_blocks(spark, sf_dir, block: int = BLOCK) -> DataFrame:
    """Grey masks: 255 where the class is above zero."""
    return _blocks(spark, sf_dir, lambda b: ((_classes(b) > 0) * 255).astype(np.uint8), 1, block)


def rgb_blocks(spark, sf_dir, block: int = BLOCK) -> DataFrame:
    """Colour pixels."""
    return _blocks(spark, sf_dir, _rgb, 3, block)


def edited_blocks(spark, sf_dir, block: int = BLOCK) -> DataFrame:
    """Colour pixels after the edit."""
    return _blocks(spark, sf_dir, _edited, 3, block)


def palette_blocks(spark, sf_dir, block: int = BLOCK) -> DataFrame:
    """Masks as palette colours; unknown classes get a colour outside the palette."""
    lut = np.array([c for c, _ in sorted(PALETTE.items(), key=lambda kv: kv[1])] + [(1, 2, 3)], dtype=np.uint8)
    return _blocks(spark, sf_dir, lambda b: lut[_classes(b)], 3, block)
