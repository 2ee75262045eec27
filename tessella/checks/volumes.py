"""Tile labels by majority, and coherence along the slices of volumes: four slides in a row are one volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check, table
from tessella.checks.tiles import FIRST, S, T
from tessella.operators import coherence, components, tiles
from tessella.session import pin

WINDOW = 3
C1, C2 = coherence.STABLE
GREY = "(er * 299 + eg * 587 + eb * 114 + 500) // 1000"
PAIRS_SQL = "pairs AS (SELECT a.k, b.k AS next_k FROM slides a JOIN slides b ON b.k = a.k + 1 AND a.k // 4 = b.k // 4)"


def slices(spark, sf):
    """Slides as slices of volumes."""
    return fx.slides(spark, sf).select(F.col("k").alias("image_id"), F.expr("k div 4").alias("volume_id"), F.col("k").alias("slice_index"), F.col("h").alias("img_h"), F.col("w").alias("img_w"))


@check("majority_label", f"""WITH {FIRST},
parts AS (SELECT g.k, tile_y, tile_x, cid, count(*) AS n
  FROM (SELECT k, tile_y, tile_x, CAST(tile_y + dy.d AS BIGINT) AS y, CAST(tile_x + dx.d AS BIGINT) AS x FROM grid, unnest(range(0, {T})) AS dy(d), unnest(range(0, {T})) AS dx(d)) g
  JOIN (SELECT k, x, y, cid FROM pixels) p ON p.k = g.k AND p.x = g.x AND p.y = g.y GROUP BY ALL),
best AS (SELECT k, tile_y, tile_x, coalesce(max(n) FILTER (cid >= 0), 0) AS most, arg_max(cid, n * 100 - cid) FILTER (cid >= 0) AS cid, bool_or(cid IN (9, 10, 11)) AS positive FROM parts GROUP BY ALL)
SELECT k, tile_y, tile_x, CASE WHEN most / {T * T}.0 > 0.6 THEN CAST(cid AS INT) END AS majority, round(most / {T * T}.0::DOUBLE, 6) AS majority_share,
  CASE WHEN positive THEN 'cancer' ELSE 'non_cancer' END AS coarse_label FROM best""")
def majority_label(spark, sf):
    found = tiles.majority_label(tiles.tile_classes(fx.class_blocks(spark, sf), T, S), T)
    return found.select(F.col("image_id").alias("k"), "tile_y", "tile_x", "majority", F.round("majority_share", 6).alias("majority_share"), "coarse_label")


def _slide(columns: str, over: str, order: str) -> str:
    return ", ".join(f"sum({c}) OVER (PARTITION BY {over} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS {c}" for c in columns.split())


_SUMS = "n e a b aa bb ab"
_N = WINDOW * WINDOW


@check("slice_similarity", f"""WITH {fx.EDITED_SQL}, {PAIRS_SQL},
grey AS (SELECT k, x, y, inside, {GREY} AS g FROM edited),
stacked AS (SELECT p.k, next_k, u.x, u.y, 1 AS n, CAST(u.inside OR v.inside AS INT) AS e, u.g AS a, v.g AS b, u.g * u.g AS aa, v.g * v.g AS bb, u.g * v.g AS ab
  FROM pairs p JOIN grey u ON u.k = p.k JOIN grey v ON v.k = next_k AND v.x = u.x AND v.y = u.y),
across AS (SELECT k, next_k, x, y, {_slide(_SUMS, "k, y", "x")} FROM stacked),
win AS (SELECT k, next_k, {_slide(_SUMS, "k, x", "y")} FROM across),
moments AS (SELECT k, next_k, a / {_N}.0::DOUBLE AS ma, b / {_N}.0::DOUBLE AS mb, ({_N} * aa - a * a) / {_N * _N}.0::DOUBLE AS va, ({_N} * bb - b * b) / {_N * _N}.0::DOUBLE AS vb, ({_N} * ab - a * b) / {_N * _N}.0::DOUBLE AS c
  FROM win WHERE n = {_N} AND e = 0),
found AS (SELECT k, count(*) AS n, avg((2 * ma * mb + {C1}) * (2 * c + {C2}) / ((ma * ma + mb * mb + {C1}) * (va + vb + {C2}))) AS s FROM moments GROUP BY k)
SELECT p.k, next_k, coalesce(n, 0)::BIGINT AS n_windows, round(s, 6) AS similarity FROM pairs p LEFT JOIN found USING (k)""")
def slice_similarity(spark, sf):
    found = coherence.slice_similarity(fx.edited_blocks(spark, sf), slices(spark, sf), fx.boxes(spark, sf), fx.BLOCK, WINDOW)
    return found.select(F.col("image_id").alias("k"), F.col("next_id").alias("next_k"), "n_windows", F.round("similarity", 6).alias("similarity"))


#: Components by runs: a run takes the smallest label of those it touches, until none changes.
COMPONENTS_SQL = fx.PIXELS_SQL + """,
fore AS (SELECT k, y, x, w, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS island FROM pixels WHERE cid > 0),
run AS (SELECT k, y, min(x) AS x0, max(x) + 1 AS x1, min(y * w + x) AS id FROM fore GROUP BY k, y, island),
touch AS (SELECT a.k, a.id AS a, b.id AS b FROM run a JOIN run b ON b.k = a.k AND b.y = a.y + 1 AND b.x0 < a.x1 AND b.x1 > a.x0),
ways AS MATERIALIZED (SELECT k, a, b FROM touch UNION ALL SELECT k, b, a FROM touch),
named(k, id, label) USING KEY (k, id) AS (
  SELECT k, id, id FROM run
  UNION
  SELECT w.k, w.b, min(n.label) FROM named n JOIN ways w ON w.k = n.k AND w.a = n.id JOIN recurring.named o ON o.k = w.k AND o.id = w.b WHERE n.label < o.label GROUP BY w.k, w.b),
part AS MATERIALIZED (SELECT r.k, y, x0, x1, label FROM run r JOIN named USING (k, id)),
comp AS (SELECT k, label AS component, sum(x1 - x0)::BIGINT AS area, min(y)::BIGINT AS y0, min(x0)::BIGINT AS x0, max(y)::BIGINT + 1 AS y1, max(x1)::BIGINT AS x1 FROM part GROUP BY k, label)"""


def _labelled(spark, sf):
    labelled = pin(components.labelled_blocks(fx.class_blocks(spark, sf), dtype=np.int8))
    return labelled, components.component_names(labelled, fx.BLOCK)


@check("mask_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT * FROM comp")
def mask_components(spark, sf):
    return components.components(*_labelled(spark, sf)).withColumnRenamed("image_id", "k")


@check("component_continuity", f"""WITH RECURSIVE {COMPONENTS_SQL}, {PAIRS_SQL},
common AS (SELECT p.k, next_k, a.label AS a, b.label AS b, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS n
  FROM pairs p JOIN part a ON a.k = p.k JOIN part b ON b.k = next_k AND b.y = a.y AND b.x0 < a.x1 AND b.x1 > a.x0 GROUP BY ALL),
total AS (SELECT k, count(*) AS n, sum(area) AS area FROM comp GROUP BY k),
met AS (SELECT k, count(DISTINCT a) AS going, count(DISTINCT b) AS coming, sum(n) AS n FROM common GROUP BY k)
SELECT p.k, next_k, coalesce(t.n, 0)::BIGINT AS components, coalesce(u.n, 0)::BIGINT AS next_components, coalesce(going, 0)::BIGINT AS continued,
  (coalesce(u.n, 0) - coalesce(coming, 0))::BIGINT AS begun, coalesce(m.n, 0)::BIGINT AS overlap,
  round(CASE WHEN coalesce(t.area, 0) + coalesce(u.area, 0) > 0 THEN 2 * coalesce(m.n, 0) / (coalesce(t.area, 0) + coalesce(u.area, 0))::DOUBLE END, 6) AS dice
FROM pairs p LEFT JOIN total t ON t.k = p.k LEFT JOIN total u ON u.k = next_k LEFT JOIN met m ON m.k = p.k""")
def component_continuity(spark, sf):
    labelled, levels = _labelled(spark, sf)
    pairs = coherence.slice_pairs(slices(spark, sf))
    overlaps = components.component_overlaps(labelled, levels, pairs, fx.BLOCK)
    found = components.continuity(components.components(labelled, levels), overlaps, pairs)
    return found.withColumnsRenamed({"image_id": "k", "next_id": "next_k"}).withColumn("dice", F.round("dice", 6))


TRAJECTORY_SQL = """
p AS (SELECT o_custkey AS volume_id, (o_orderdate::DATE - DATE '1990-01-01')::INT AS slice_index, avg((o_orderkey * 37 % 1000) / 1000.0::DOUBLE) AS v FROM orders GROUP BY ALL),
q AS (SELECT *, lead(v) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(slice_index) OVER w AS s1, lead(slice_index, 2) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY volume_id ORDER BY slice_index)),
steps AS (SELECT volume_id, slice_index, (v1 - v) / (s1 - slice_index) AS step, 2 * ((v2 - v1) / (s2 - s1) - (v1 - v) / (s1 - slice_index)) / (s2 - slice_index) AS bend FROM q)"""


@check("trajectory_roughness", f"""WITH {TRAJECTORY_SQL} SELECT volume_id, count(*) AS n_slices, round(avg(abs(step)), 6) AS mean_step, round(avg(bend * bend), 6) AS roughness,
  round(max(abs(bend)), 6) AS sharpest_bend FROM steps GROUP BY volume_id""")
def trajectory_roughness(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    points = table(spark, sf, "orders").select(F.col("o_custkey").alias("volume_id"), day.alias("slice_index"), (F.col("o_orderkey") * 37 % 1000 / 1000.0).alias("value"))
    found = coherence.trajectory_roughness(coherence.slice_steps(points))
    return found.select("volume_id", "n_slices", *(F.round(c, 6).alias(c) for c in ("mean_step", "roughness", "sharpest_bend")))
