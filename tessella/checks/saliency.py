"""Activation maps and quantile masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check, table
from tessella.checks.roi import as_k
from tessella.checks.stencils import weights_sql
from tessella.operators import blocks, saliency
from tessella.session import pin

HEAT_SQL = """
emb AS (SELECT vec_id AS id, CAST(v AS DOUBLE) AS v, (e - 1) // 16 AS ch, (e - 1) % 16 AS px FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS e FROM embeddings) q),
wts AS (SELECT id - 1 AS id, ch, sum(v) / count(*) AS wt FROM emb GROUP BY id, ch),
raw AS (SELECT a.id, a.px, greatest(0.0, sum(a.v * wts.wt)) AS v FROM emb a JOIN wts USING (id, ch) GROUP BY a.id, a.px),
span AS (SELECT id, min(v) AS lo, max(v) AS hi FROM raw GROUP BY id),
cam AS (SELECT id, px, (v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS v FROM raw JOIN span USING (id)),
frame AS (SELECT id, h, w, y0c, x0c, least(4, y0c + hc) AS y1c, least(4, x0c + wc) AS x1c FROM (SELECT id, h, w, CAST(round_even(((64 - nh) // 2) * 0.0625::DOUBLE, 0) AS INT) AS y0c, CAST(round_even(((64 - nw) // 2) * 0.0625::DOUBLE, 0) AS INT) AS x0c, CAST(round_even(nh * 0.0625::DOUBLE, 0) AS INT) AS hc, CAST(round_even(nw * 0.0625::DOUBLE, 0) AS INT) AS wc
  FROM (SELECT *, greatest(1, CAST(round_even(w * (64.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS nw, greatest(1, CAST(round_even(h * (64.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS nh FROM (SELECT vec_id AS id, CAST(20 + (vec_id % 5) * 8 AS INT) AS w, CAST(24 + (vec_id % 4) * 6 AS INT) AS h FROM embeddings) a) b) c),
heat AS (SELECT c.id, c.px // 4 - y0c AS y, c.px % 4 - x0c AS x, floor(v * 1e6 + 0.501) / 1e6 AS v, y1c - y0c AS hh, x1c - x0c AS ww, h, w FROM cam c JOIN frame f USING (id) WHERE c.px // 4 >= y0c AND c.px // 4 < y1c AND c.px % 4 >= x0c AND c.px % 4 < x1c)
"""
UP_SQL = HEAT_SQL + f""",
{weights_sql('wx', 'SELECT DISTINCT ww AS n_in, w AS n_out FROM heat', wide='1.0')}, {weights_sql('wy', 'SELECT DISTINCT hh AS n_in, h AS n_out FROM heat', wide='1.0')},
up_a AS (SELECT s.id, s.y, wx.i AS x, any_value(hh) AS hh, any_value(h) AS h, sum(wx.wt * v) AS v FROM heat s JOIN wx ON wx.n_in = s.ww AND wx.n_out = s.w AND wx.j = s.x GROUP BY s.id, s.y, wx.i),
up AS (SELECT a.id, wy.i AS y, a.x, floor(sum(wy.wt * v) * 1e6 + 0.501) / 1e6 AS v FROM up_a a JOIN wy ON wy.n_in = a.hh AND wy.n_out = a.h AND wy.j = a.y GROUP BY a.id, wy.i, a.x)
"""


def _channels(spark, sf):
    """Four channels of sixteen cells per vector; gradients come from the next vector."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("image_id"), F.col("embedding").cast("array<double>").alias("v"))
    split = emb.select("image_id", F.posexplode(F.expr("transform(sequence(0, size(v) div 16 - 1), c -> slice(v, c * 16 + 1, 16))")).alias("channel", "cells"))
    grads = split.select((F.col("image_id") - 1).alias("image_id"), "channel", F.col("cells").alias("gradient"))
    return split.withColumnRenamed("cells", "activation").join(grads, ["image_id", "channel"])


def _frames(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("cast(vec_id as int) AS image_id", "cast(20 + (vec_id % 5) * 8 as int) AS w", "cast(24 + (vec_id % 4) * 6 as int) AS h")


def _heat(spark, sf):
    heat = saliency.heat_blocks(saliency.activation_map(_channels(spark, sf)), 4, 4)
    return saliency.unpad(heat, _frames(spark, sf), fx.BLOCK, 64)


@check("activation_map", f"WITH {HEAT_SQL} SELECT CAST(id AS INT) AS k, CAST(px AS INT) AS pixel, round(v, 6) AS v FROM cam")
def activation_map(spark, sf):
    return as_k(saliency.activation_map(_channels(spark, sf))).select("k", "pixel", F.round("v", 6).alias("v"))


@check("heatmap_unpad", f"WITH {UP_SQL} SELECT CAST(id AS INT) AS k, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS v FROM up")
def heatmap_unpad(spark, sf):
    import numpy as np

    return as_k(blocks.pixel_rows(_heat(spark, sf), np.float64)).select("k", "y", "x", F.round("v", 6).alias("v"))


@check("quantile_mask", f"""WITH {UP_SQL}, q AS (SELECT id, count(*) AS n, quantile_cont(v, 0.85) AS q, quantile_cont(v, 0.75) AS lo, quantile_cont(v, 0.95) AS hi FROM up GROUP BY id),
  a AS (SELECT id, q, lo, hi, count(*) FILTER (v >= q) / count(*) AS area, count(*) FILTER (v >= lo) / count(*) AS lo_area FROM up JOIN q USING (id) GROUP BY ALL),
  c AS (SELECT id, CASE WHEN CASE WHEN area < 0.16 THEN lo_area ELSE area END > 0.252 THEN hi WHEN area < 0.16 THEN lo ELSE q END AS cut FROM a)
  SELECT CAST(id AS INT) AS k, floor(cut * 1e6 + 0.501) / 1e6 AS cut, count(*) FILTER (v >= cut) AS n_on FROM up JOIN c USING (id) GROUP BY id, cut""")
def quantile_mask(spark, sf):
    heat = pin(_heat(spark, sf))  # read by both passes of the cuts and by the masks
    cuts = pin(saliency.heat_cuts(heat, _frames(spark, sf), fx.BLOCK, 0.85, 0.16, 0.252))
    mask = saliency.cut_masks(heat, cuts, _frames(spark, sf), fx.BLOCK)
    on = blocks.digest(mask).select("image_id", (F.col("sum_v") / 255).cast("bigint").alias("n_on"))
    return as_k(on.join(cuts, "image_id")).select("k", (F.floor(F.col("cut") * 1e6 + 0.501) / 1e6).alias("cut"), "n_on")
