"""Class maps, regions, boxes and tile crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check
from tessella.checks.tiles import COVER, T, mined
from tessella.functions import labels
from tessella.operators import blocks, roi
from tessella.operators.saliency import exact_quantiles
from tessella.session import pin

PLACE = "((y * 131 + x * 7) % 1009 + 1)"


def digest_sql(source: str, key: str = "k", channels=("r", "g", "b")) -> str:
    """SQL twin of the position-dependent fingerprint."""
    total = " + ".join(channels)
    placed = " + ".join(f"{c} * ({PLACE} + {i})" for i, c in enumerate(channels))
    return f"SELECT {key}, CAST(count(*) * {len(channels)} AS BIGINT) AS n_values, CAST(sum({total}) AS BIGINT) AS sum_v, CAST(sum({placed}) AS BIGINT) AS pos_sum FROM {source} GROUP BY {key}"


def as_k(df):
    return df.withColumnRenamed("image_id", "k")


@check("palette_decode", f"WITH {fx.PIXELS_SQL} SELECT k, cid, count(*) AS n FROM pixels GROUP BY ALL")
def palette_decode(spark, sf):
    return as_k(roi.class_counts(roi.decode_palette(fx.palette_blocks(spark, sf))))


@check("class_hist", f"WITH {fx.PIXELS_SQL} SELECT k, cid, count(*) AS n FROM pixels GROUP BY ALL")
def class_hist(spark, sf):
    return as_k(roi.class_counts(fx.class_blocks(spark, sf)))


@check("dominant_class", f"""WITH {fx.PIXELS_SQL}, hist AS (SELECT k, cid, count(*) AS n FROM pixels GROUP BY ALL)
  SELECT k, coalesce(string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) FILTER (cid >= 0), '') AS classes_present, CAST(coalesce(arg_max(cid, n * 100 - cid) FILTER (cid > 0), 0) AS INT) AS dominant_class_id FROM hist GROUP BY k""")
def dominant_class(spark, sf):
    c = roi.image_classes(roi.class_counts(fx.class_blocks(spark, sf)))
    return c.select(F.col("image_id").alias("k"), F.array_join(F.col("classes_present").cast("array<string>"), ",").alias("classes_present"), "dominant_class_id")


@check("roi_mask", f"WITH {fx.PIXELS_SQL}, m AS (SELECT k, x, y, CASE WHEN cid > 0 AND cid NOT IN (5, 6) THEN 255 ELSE 0 END AS v FROM pixels) {digest_sql('m', channels=('v',))}")
def roi_mask(spark, sf):
    classes = roi.decode_palette(fx.palette_blocks(spark, sf), unknown=0)
    return as_k(blocks.digest(roi.roi_blocks(classes, exclude=(5, 6))))


@check("roi_coverage", f"""WITH {fx.PIXELS_SQL}, c AS (SELECT k, avg(CASE WHEN cid IN (1, 2, 3, 4) THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM pixels GROUP BY k)
  SELECT k, round(coverage, 6) AS coverage, round((SELECT avg(coverage) FROM c), 6) AS mean, round((SELECT quantile_cont(coverage, 0.5) FROM c), 6) AS median FROM c""")
def roi_coverage(spark, sf):
    cover = roi.roi_coverage(roi.roi_blocks(fx.class_blocks(spark, sf), include=(1, 2, 3, 4))).withColumnRenamed("image_id", "k")
    cover = pin(cover)  # a row per image, read three times
    counts = cover.groupBy(F.lit(0).alias("all"), F.col("coverage").alias("v")).agg(F.count("*").alias("n"))
    median = exact_quantiles(counts, "all", [0.5]).select(F.round("q", 6).alias("median"))
    mean = cover.agg(F.round(F.avg("coverage"), 6).alias("mean"))
    return cover.select("k", F.round("coverage", 6).alias("coverage"), mean.scalar().alias("mean"), median.scalar().alias("median"))


BBOX_SQL = f"""ext AS (SELECT k, any_value(w) AS w, any_value(h) AS h, min(y) FILTER (on_) AS y0, min(x) FILTER (on_) AS x0, max(y) FILTER (on_) + 1 AS y1, max(x) FILTER (on_) + 1 AS x1
    FROM (SELECT *, coalesce(cid = 1 + k % 11, false) AS on_ FROM pixels) q GROUP BY k),
  bbox AS (SELECT k, w, h, CASE WHEN y0 IS NULL THEN 0 ELSE greatest(0, y0 - CAST(floor((y1 - y0) * 0.15::DOUBLE) AS BIGINT)) END AS y0, CASE WHEN y0 IS NULL THEN 0 ELSE greatest(0, x0 - CAST(floor((x1 - x0) * 0.15::DOUBLE) AS BIGINT)) END AS x0,
    CASE WHEN y0 IS NULL THEN h ELSE least(h, y1 + CAST(floor((y1 - y0) * 0.15::DOUBLE) AS BIGINT)) END AS y1, CASE WHEN y0 IS NULL THEN w ELSE least(w, x1 + CAST(floor((x1 - x0) * 0.15::DOUBLE) AS BIGINT)) END AS x1 FROM ext),
  square AS (SELECT k, w, h, CASE WHEN bw > bh AND sy1 - sy0 < bw THEN greatest(0, sy1 - bw) WHEN bw > bh THEN sy0 ELSE y0 END AS y0, CASE WHEN bw > bh THEN sy1 ELSE y1 END AS y1,
      CASE WHEN bh > bw AND sx1 - sx0 < bh THEN greatest(0, sx1 - bh) WHEN bh > bw THEN sx0 ELSE x0 END AS x0, CASE WHEN bh > bw THEN sx1 ELSE x1 END AS x1
    FROM (SELECT *, least(w, sx0 + bh) AS sx1, least(h, sy0 + bw) AS sy1 FROM (SELECT *, y1 - y0 AS bh, x1 - x0 AS bw, greatest(0, x0 - (y1 - y0 - (x1 - x0)) // 2) AS sx0, greatest(0, y0 - (x1 - x0 - (y1 - y0)) // 2) AS sy0 FROM bbox) q) q2)"""


def _one_class(spark, sf):
    """Masks of one class per slide, so that boxes differ in place and size."""
    import numpy as np

    def kernel(b):
        on = blocks.pixels(b, np.int8) == 1 + b["image_id"] % 11
        return blocks.block_row(b, b["y0"], b["x0"], (on * 255).astype(np.uint8))

    return blocks.map_blocks(fx.class_blocks(spark, sf), kernel, blocks.BLOCK_FIELDS)


@check("roi_bbox", f"WITH {fx.PIXELS_SQL}, {BBOX_SQL} SELECT k, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(y1 AS INT) AS y1, CAST(x1 AS INT) AS x1 FROM bbox")
def roi_bbox(spark, sf):
    return as_k(roi.mask_boxes(_one_class(spark, sf))).select("k", "box.y0", "box.x0", "box.y1", "box.x1")


@check("bbox_square", f"WITH {fx.PIXELS_SQL}, {BBOX_SQL} SELECT k, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(y1 AS INT) AS y1, CAST(x1 AS INT) AS x1 FROM square")
def bbox_square(spark, sf):
    return as_k(roi.mask_boxes(_one_class(spark, sf), square=True)).select("k", "box.y0", "box.x0", "box.y1", "box.x1")


@check("patch_meta", f"""WITH {fx.PIXELS_SQL}, {BBOX_SQL} SELECT s.k, CASE WHEN m.stem IS NULL THEN 'missing_mask' WHEN m.w <> s.w THEN 'size_mismatch' ELSE 'ok' END AS status, CAST(q.y1 - q.y0 AS INT) AS bbox_height, CAST(q.x1 - q.x0 AS INT) AS bbox_width,
  CASE WHEN q.k IS NOT NULL THEN round(512.0 / greatest(q.x1 - q.x0, 1), 6)::DOUBLE END AS scale_x, CASE WHEN q.k IS NOT NULL THEN round(512.0 / greatest(q.y1 - q.y0, 1), 6)::DOUBLE END AS scale_y FROM slides s LEFT JOIN masks m USING (stem) LEFT JOIN square q ON q.k = s.k AND m.w = s.w""")
def patch_meta(spark, sf):
    from tessella.operators.joins import size_status

    m = fx.masks(spark, sf).select("stem", F.col("w").alias("mask_w"), F.col("h").alias("mask_h"))
    rows = size_status(fx.slides(spark, sf).join(m, "stem", "left"))
    geometry = roi.patch_geometry(roi.mask_boxes(_one_class(spark, sf), square=True), 512).withColumn("status", F.lit("ok"))
    made = rows.join(geometry.withColumnRenamed("image_id", "k"), ["k", "status"], "left")
    return made.select("k", "status", "bbox_height", "bbox_width", F.round("scale_x", 6).alias("scale_x"), F.round("scale_y", 6).alias("scale_y"))


@check("tile_crop", f"""WITH {COVER}, px AS (SELECT m.k, m.tile_y, m.tile_x, p.x, p.y, r, g, b FROM (SELECT k, tile_y, tile_x, CAST(tile_y + dy.d AS BIGINT) AS y, CAST(tile_x + dx.d AS BIGINT) AS x FROM mined, unnest(range(0, {T})) AS dy(d), unnest(range(0, {T})) AS dx(d)) m
    JOIN (SELECT k, x, y, r, g, b FROM pixels) p ON p.k = m.k AND p.x = m.x AND p.y = m.y) {digest_sql('px', 'k, tile_y, tile_x')}""")
def tile_crop(spark, sf):
    keys = ["image_id", "tile_y", "tile_x"]
    tiles = mined(spark, sf).select(
        *keys, F.col("tile_x").alias("x0"), F.col("tile_y").alias("y0"), (F.col("tile_x") + T).alias("x1"), (F.col("tile_y") + T).alias("y1")
    )
    return as_k(blocks.digest(blocks.crop_tiles(tiles, fx.rgb_blocks(spark, sf), fx.BLOCK, keys), keys=keys))
