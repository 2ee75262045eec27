"""Edits, blending and quality control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check
from tessella.checks.roi import as_k, digest_sql
from tessella.checks.stencils import _profile_sql
from tessella.checks.tiles import COVER, T, mined
from tessella.operators import blend, blocks, quality, seams
from tessella.plans import patches

B = fx.BLOCK
DIFF = "(abs(r - er) + abs(g - eg) + abs(b - eb))"
METRICS = fx.EDITED_SQL + f""",
cover AS (SELECT k, CAST(count(*) FILTER ({DIFF} > 30) / count(*) AS DOUBLE) AS mask_coverage FROM edited WHERE inside GROUP BY k),
drift AS (SELECT k, sum({DIFF}) / (3.0::DOUBLE * count(*)) AS non_roi_drift FROM edited WHERE NOT inside GROUP BY k),
seam AS (SELECT k, sum({DIFF}) / (3.0::DOUBLE * count(*)) AS seam_quality FROM (SELECT * FROM edited WHERE x = x0 AND y >= y0 - 8 AND y < y0 + 8 UNION ALL SELECT * FROM edited WHERE x = x1 - 1 AND y >= y1 - 8 AND y < y1 + 8) q GROUP BY k),
bins AS (SELECT k, c, bin, CAST(sum(o) AS DOUBLE) AS a, CAST(sum(e) AS DOUBLE) AS b FROM (
  SELECT k, 0 AS c, least(63, r * 64 // 255) AS bin, 1 AS o, 0 AS e FROM edited WHERE NOT inside UNION ALL SELECT k, 0, least(63, er * 64 // 255), 0, 1 FROM edited WHERE NOT inside
  UNION ALL SELECT k, 1, least(63, g * 64 // 255), 1, 0 FROM edited WHERE NOT inside UNION ALL SELECT k, 1, least(63, eg * 64 // 255), 0, 1 FROM edited WHERE NOT inside
  UNION ALL SELECT k, 2, least(63, b * 64 // 255), 1, 0 FROM edited WHERE NOT inside UNION ALL SELECT k, 2, least(63, eb * 64 // 255), 0, 1 FROM edited WHERE NOT inside) q GROUP BY ALL),
corr_ AS (SELECT k, avg(CASE WHEN sp > 0 THEN (64 * ab - a * b) / sp END) AS r, bool_or(sp = 0) AS flat FROM (SELECT k, c, sum(a) AS a, sum(b) AS b, sum(a * b) AS ab, sqrt((64 * sum(a * a) - sum(a) * sum(a)) * (64 * sum(b * b) - sum(b) * sum(b))) AS sp FROM bins GROUP BY k, c) q GROUP BY k),
metrics AS (SELECT s.k, coalesce(mask_coverage, 0) AS mask_coverage, non_roi_drift, coalesce(seam_quality, 0) AS seam_quality, CASE WHEN c.k IS NULL THEN 1.0 WHEN NOT flat THEN r END AS histogram_similarity
  FROM slides s LEFT JOIN cover USING (k) LEFT JOIN drift USING (k) LEFT JOIN seam USING (k) LEFT JOIN corr_ c ON c.k = s.k),
rules AS (SELECT k, CASE WHEN mask_coverage < 0.3 THEN concat('mask_coverage ', printf('%.4f', mask_coverage), ' < 0.3') END AS r1, CASE WHEN non_roi_drift > 0.03 THEN concat('non_roi_drift ', printf('%.2f', non_roi_drift), ' > 0.03') END AS r2,
  CASE WHEN seam_quality > 12.0 THEN concat('seam_quality ', printf('%.2f', seam_quality), ' > 12.0') END AS r3, CASE WHEN histogram_similarity < 0.95 THEN concat('histogram_similarity ', printf('%.4f', histogram_similarity), ' < 0.95') END AS r4 FROM metrics)
"""
LIMITS = quality.Limits(min_coverage=0.3, max_drift=0.03, max_seam=12.0, min_similarity=0.95)


def _metrics(spark, sf):
    return quality.edit_metrics(quality.edit_counters(fx.rgb_blocks(spark, sf), fx.edited_blocks(spark, sf), fx.boxes(spark, sf), B, moments=True))


def _metric_check(key: str, column: str):
    def run(spark, sf):
        return _metrics(spark, sf).select(F.col("image_id").alias("k"), F.round(column, 6).alias(column))

    check(key, f"WITH {METRICS} SELECT k, round({column}, 6) AS {column} FROM metrics")(run)


for _key, _column in (("qc_coverage", "mask_coverage"), ("qc_drift", "non_roi_drift"), ("qc_seam", "seam_quality"), ("qc_hist", "histogram_similarity")):
    _metric_check(_key, _column)


@check("qc_rules", f"WITH {METRICS} SELECT k, concat_ws(';', r1, r2, r3, r4) AS rejection_reasons, r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL AS passed FROM rules")
def qc_rules(spark, sf):
    judged = patches.judge_edits(fx.rgb_blocks(spark, sf), fx.edited_blocks(spark, sf), fx.boxes(spark, sf), B, LIMITS)
    return judged.select(F.col("image_id").alias("k"), F.array_join("rejection_reasons", ";").alias("rejection_reasons"), "passed")


@check("qc_summary", f"WITH {METRICS} SELECT count(*) AS checked, count(*) FILTER (p) AS passed, count(*) FILTER (NOT p) AS failed, round(count(*) FILTER (p) / count(*), 6) AS pass_rate FROM (SELECT r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL AS p FROM rules) q")
def qc_summary(spark, sf):
    return quality.quality_summary(quality.judge(_metrics(spark, sf), LIMITS)).withColumn("pass_rate", F.round("pass_rate", 6))


@check("blend_paste", f"""WITH {fx.EDITED_SQL}, prof AS ({_profile_sql('y', 'h', 'y0', 'y1', 4)} UNION ALL {_profile_sql('x', 'w', 'x0', 'x1', 4)}),
  mixed AS (SELECT e.k, e.x, e.y, inside, r, g, b, er, eg, eb, py.weight * px.weight AS t FROM edited e JOIN prof py ON py.k = e.k AND py.axis = 'y' AND py.i = e.y JOIN prof px ON px.k = e.k AND px.axis = 'x' AND px.i = e.x),
  o AS (SELECT k, x, y, CASE WHEN inside THEN CAST(floor(round(r * (1.0::DOUBLE - t) + er * t, 6)) AS BIGINT) ELSE r END AS r, CASE WHEN inside THEN CAST(floor(round(g * (1.0::DOUBLE - t) + eg * t, 6)) AS BIGINT) ELSE g END AS g, CASE WHEN inside THEN CAST(floor(round(b * (1.0::DOUBLE - t) + eb * t, 6)) AS BIGINT) ELSE b END AS b FROM mixed)
  {digest_sql('o')}""")
def blend_paste(spark, sf):
    return as_k(blocks.digest(blend.paste_back(fx.rgb_blocks(spark, sf), fx.edited_blocks(spark, sf), fx.boxes(spark, sf), B, 4)))


def flip_inside(images, masks, prompts, seeds):
    """Deterministic editor for checks: the mask is inverted in colour and shifted by the seed."""
    return [np.where(m[:, :, None] > 0, (255 - i.astype(np.int64) + s) % 256, i).astype(np.uint8) for i, m, s in zip(images, masks, seeds)]


@check("batch_edit", f"""WITH {COVER}, px AS (SELECT m.k, m.tile_y, m.tile_x, p.x, p.y, CASE WHEN cid > 0 THEN (255 - r + 7 + m.k) % 256 ELSE r END AS r, CASE WHEN cid > 0 THEN (255 - g + 7 + m.k) % 256 ELSE g END AS g, CASE WHEN cid > 0 THEN (255 - b + 7 + m.k) % 256 ELSE b END AS b
    FROM (SELECT k, tile_y, tile_x, CAST(tile_y + dy.d AS BIGINT) AS y, CAST(tile_x + dx.d AS BIGINT) AS x FROM mined, unnest(range(0, {T})) AS dy(d), unnest(range(0, {T})) AS dx(d)) m JOIN (SELECT k, x, y, r, g, b, cid FROM pixels) p ON p.k = m.k AND p.x = m.x AND p.y = m.y), d AS ({digest_sql('px', 'k, tile_y, tile_x')})
  SELECT d.*, CAST(7 + k AS BIGINT) AS seed, CASE WHEN k % 2 = 0 THEN 'edit cancer, malignant skin histology pattern with dysplastic morphology' ELSE 'edit other, skin histology tissue pattern' END AS prompt FROM d""")
def batch_edit(spark, sf):
    keys = ["image_id", "tile_y", "tile_x"]
    tiles = mined(spark, sf).select(*keys, F.col("tile_x").alias("x0"), F.col("tile_y").alias("y0"), (F.col("tile_x") + T).alias("x1"), (F.col("tile_y") + T).alias("y1"))
    crops = patches.labelled_crops(tiles, fx.rgb_blocks(spark, sf), fx.mask_blocks(spark, sf), B, keys)
    labelled = crops.withColumn("coarse_label", F.expr("CASE WHEN image_id % 2 = 0 THEN 'cancer' ELSE 'other' END"))
    edited = seams.batch_edit(patches.edit_plan(labelled, "edit {token}{descriptor_suffix}", 7, "image_id"), flip_inside)
    return as_k(blocks.digest(edited, keys=[*keys, "seed", "prompt"]))
