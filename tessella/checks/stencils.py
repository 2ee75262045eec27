"""Resizing, dilation, soft masks, brushes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check
from tessella.checks.roi import as_k, digest_sql
from tessella.checks.tiles import COVER, T, mined
from tessella.operators import blend, blocks, masks, resample
from tessella.session import pin

B = fx.BLOCK
MASK_SQL = fx.PIXELS_SQL + ", mask AS (SELECT k, x, y, w, h, CASE WHEN cid > 0 THEN 255 ELSE 0 END AS v FROM pixels)"


def weights_sql(name: str, dims: str, wide: str = "greatest(n_in / n_out::DOUBLE, 1.0)", fn: str = "greatest(0.0, 1.0 - abs(t))", reach: str = "1") -> str:
    """CTE of resize weights ``(n_in, n_out, i, j, wt)`` for the axis lengths of a query."""
    return f"""{name} AS (SELECT n_in, n_out, i, j, wt / sum(wt) OVER (PARTITION BY n_in, n_out, i) AS wt FROM (SELECT n_in, n_out, i, j, {fn} AS wt FROM (
      SELECT n_in, n_out, u.i, v.j, (v.j + 0.5::DOUBLE - (u.i + 0.5::DOUBLE) * n_in / n_out) / ({wide}) AS t FROM ({dims}) d, unnest(range(0, n_out)) AS u(i), unnest(range(0, n_in)) AS v(j)) q WHERE abs(t) < {reach}) q2)"""


def resize_sql(source: str, out: str, out_h: str, out_w: str, channels=("r", "g", "b"), key: str = "k", finish: str = "least(255, greatest(0, CAST(floor(round({c}, 6) + 0.5) AS BIGINT)))") -> str:
    """CTEs resizing relation ``source(key, y, x, h, w, channels)`` with weight tables ``wx`` and ``wy``."""
    keys = ", ".join(f"s.{c.strip()}" for c in key.split(","))
    keys2 = ", ".join(f"a.{c.strip()}" for c in key.split(","))
    first = ", ".join(f"sum(wx.wt * s.{c}) AS {c}" for c in channels)
    last = ", ".join(finish.format(c=f"sum(wy.wt * a.{c})") + f" AS {c}" for c in channels)
    return f"""{out}_a AS (SELECT {keys}, s.y, wx.i AS x, any_value(s.h) AS h, any_value(s.w) AS w, {first} FROM {source} s JOIN wx ON wx.n_in = s.w AND wx.n_out = {out_w} AND wx.j = s.x GROUP BY {keys}, s.y, wx.i),
  {out} AS (SELECT {keys2}, wy.i AS y, a.x, {last} FROM {out}_a a JOIN wy ON wy.n_in = a.h AND wy.n_out = {out_h.replace('s.', 'a.')} AND wy.j = a.y GROUP BY {keys2}, wy.i, a.x)"""


@check("resize_nearest", f"""WITH {MASK_SQL}, o AS (SELECT s.k, i.i AS y, j.j AS x, CAST(((2 * i.i + 1) * s.h) // 34 AS BIGINT) AS sy, CAST(((2 * j.j + 1) * s.w) // 46 AS BIGINT) AS sx FROM slides s, unnest(range(0, 17)) AS i(i), unnest(range(0, 23)) AS j(j)),
  r AS (SELECT o.k, o.y, o.x, m.v FROM o JOIN mask m ON m.k = o.k AND m.y = o.sy AND m.x = o.sx) {digest_sql('r', channels=('v',))}""")
def resize_nearest(spark, sf):
    return as_k(blocks.digest(resample.resize_nearest(fx.mask_blocks(spark, sf), B, lambda b: (17, 23))))


@check("resize_bilinear", f"""WITH {fx.PIXELS_SQL}, {weights_sql('wx', 'SELECT DISTINCT w AS n_in, 20 AS n_out FROM slides')}, {weights_sql('wy', 'SELECT DISTINCT h AS n_in, 16 AS n_out FROM slides')},
  {resize_sql('pixels', 'r', '16', '20')} {digest_sql('r')}""")
def resize_bilinear(spark, sf):
    return as_k(blocks.digest(resample.resize_linear(fx.rgb_blocks(spark, sf), B, lambda b: (16, 20))))


@check("letterbox", f"""WITH {fx.PIXELS_SQL}, geo AS (SELECT k, w, h, nw, nh, (32 - nw) // 2 AS x0, (32 - nh) // 2 AS y0 FROM (SELECT k, w, h, greatest(1, CAST(round_even(w * (32.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS nw, greatest(1, CAST(round_even(h * (32.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS nh FROM slides) q),
  src AS (SELECT p.*, nw, nh FROM pixels p JOIN geo USING (k)),
  {weights_sql('wx', 'SELECT DISTINCT w AS n_in, nw AS n_out FROM geo')}, {weights_sql('wy', 'SELECT DISTINCT h AS n_in, nh AS n_out FROM geo')},
  a AS (SELECT s.k, s.y, wx.i AS x, any_value(s.h) AS h, any_value(s.nh) AS nh, sum(wx.wt * r) AS r, sum(wx.wt * g) AS g, sum(wx.wt * b) AS b FROM src s JOIN wx ON wx.n_in = s.w AND wx.n_out = s.nw AND wx.j = s.x GROUP BY s.k, s.y, wx.i),
  o AS (SELECT a.k, wy.i AS y, a.x, CAST(floor(round(sum(wy.wt * r), 6) + 0.5) AS BIGINT) AS r, CAST(floor(round(sum(wy.wt * g), 6) + 0.5) AS BIGINT) AS g, CAST(floor(round(sum(wy.wt * b), 6) + 0.5) AS BIGINT) AS b FROM a JOIN wy ON wy.n_in = a.h AND wy.n_out = a.nh AND wy.j = a.y GROUP BY a.k, wy.i, a.x),
  placed AS (SELECT o.k, o.y + y0 AS y, o.x + x0 AS x, r, g, b FROM o JOIN geo USING (k)),
  d AS ({digest_sql('placed')}), m AS (SELECT k, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM placed GROUP BY k)
  SELECT d.k, CAST(3072 AS BIGINT) AS n_values, d.sum_v, d.pos_sum, round((r / 1024.0::DOUBLE / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 5) AS mean_r, round((g / 1024.0::DOUBLE / 255 - 0.456::DOUBLE) / 0.224::DOUBLE, 5) AS mean_g, round((b / 1024.0::DOUBLE / 255 - 0.406::DOUBLE) / 0.225::DOUBLE, 5) AS mean_b FROM d JOIN m USING (k)""")
def letterbox(spark, sf):
    boxed = pin(resample.letterbox(fx.rgb_blocks(spark, sf), B, 32))  # read twice

    def means(b):
        total = blocks.pixels(b, np.float64).sum(axis=(0, 1))
        return {"r": total[0:1], "g": total[1:2], "b": total[2:3]}

    norm = blocks.map_blocks(resample.normalise_channels(boxed), means, "r double, g double, b double").groupBy("image_id")
    mean = norm.agg(*[F.round(F.sum(c) / 1024, 5).alias(f"mean_{c}") for c in "rgb"])
    return as_k(blocks.digest(boxed).join(mean, "image_id"))


def _gauss_terms(sigma: float, cell) -> str:
    w = masks.gauss(sigma)
    r = len(w) // 2
    return " + ".join(f"{v!r}::DOUBLE * {cell(d - r)}" for d, v in enumerate(w.tolist()))


@check("dilate_max", f"""WITH {MASK_SQL}, a AS (SELECT k, x, y, max(v) OVER (PARTITION BY k, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM mask),
  d AS (SELECT k, x, y, max(v) OVER (PARTITION BY k, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM a) {digest_sql('d', channels=('v',))}""")
def dilate_max(spark, sf):
    return as_k(blocks.digest(masks.dilate(fx.mask_blocks(spark, sf), B, 2.6)))


@check("soft_mask", f"""WITH {MASK_SQL}, rows_ AS (SELECT k, y, any_value(w) AS w, any_value(h) AS h, list(v ORDER BY x) AS l FROM mask GROUP BY k, y),
  a AS (SELECT k, y, h, u.x, {_gauss_terms(1.5, lambda d: f"l[greatest(0, least(w - 1, u.x + {d})) + 1]")} AS v FROM rows_, unnest(range(0, w)) AS u(x)),
  cols AS (SELECT k, x, any_value(h) AS h, list(v ORDER BY y) AS l FROM a GROUP BY k, x),
  b AS (SELECT k, x, u.y, floor(round({_gauss_terms(1.5, lambda d: f"l[greatest(0, least(h - 1, u.y + {d})) + 1]")}, 6) + 0.5) AS v FROM cols, unnest(range(0, h)) AS u(y)),
  s AS (SELECT k, x, y, CAST(floor(round(least(255, v * 1.25::DOUBLE), 6)) AS BIGINT) AS v FROM b) {digest_sql('s', channels=('v',))}""")
def soft_mask(spark, sf):
    return as_k(blocks.digest(masks.soften(fx.mask_blocks(spark, sf), B, 1.5, 1.25)))


@check("tissue_mask", f"WITH {fx.PIXELS_SQL}, m AS (SELECT k, x, y, CASE WHEN r < 235 OR g < 235 OR b < 235 THEN 255 ELSE 0 END AS v FROM pixels) {digest_sql('m', channels=('v',))}")
def tissue_mask(spark, sf):
    return as_k(blocks.digest(masks.tissue(fx.rgb_blocks(spark, sf))))


@check("overlay_tint", f"""WITH {fx.PIXELS_SQL}, o AS (SELECT k, x, y, CASE WHEN cid > 0 THEN CAST(floor(round(r * 0.6::DOUBLE + 102.0::DOUBLE, 6)) AS BIGINT) ELSE r END AS r, CASE WHEN cid > 0 THEN CAST(floor(round(g * 0.6::DOUBLE, 6)) AS BIGINT) ELSE g END AS g, CASE WHEN cid > 0 THEN CAST(floor(round(b * 0.6::DOUBLE, 6)) AS BIGINT) ELSE b END AS b FROM pixels) {digest_sql('o')}""")
def overlay_tint(spark, sf):
    return as_k(blocks.digest(masks.tint(fx.rgb_blocks(spark, sf), fx.mask_blocks(spark, sf))))


def _profile_sql(axis: str, n: str, lo: str, hi: str, r: int) -> str:
    inside = lambda d: f"CASE WHEN c_{'m' if d < 0 else 'p'}{abs(d)} >= {lo} AND c_{'m' if d < 0 else 'p'}{abs(d)} < {hi} THEN 1 ELSE 0 END"
    reach = len(masks.gauss(r / 2.0)) // 2
    cells = ", ".join(f"CASE WHEN u.i + {d} < 0 THEN -1 - (u.i + {d}) WHEN u.i + {d} >= {n} THEN 2 * {n} - 1 - (u.i + {d}) ELSE u.i + {d} END AS c_{'m' if d < 0 else 'p'}{abs(d)}" for d in range(-reach, reach + 1))
    return f"SELECT k, '{axis}' AS axis, CAST(i AS INT) AS i, CASE WHEN i >= {lo} - {r} AND i < {hi} + {r} THEN {_gauss_terms(r / 2.0, inside)} ELSE 0.0 END AS weight FROM (SELECT *, {cells} FROM boxes, unnest(range(0, {n})) AS u(i)) q"


@check("feather_weights", f"""WITH {fx.EDITED_SQL} SELECT k, axis, i, round(weight, 6) AS weight FROM ({_profile_sql('y', 'h', 'y0', 'y1', 4)} UNION ALL {_profile_sql('x', 'w', 'x0', 'x1', 4)}) q""")
def feather_weights(spark, sf):
    p = blend.feather_profiles(fx.boxes(spark, sf), 4)
    return p.select(F.col("image_id").alias("k"), "axis", "i", F.round("weight", 6).alias("weight"))


BRUSH = masks.Brush(attempts=5, max_strokes=2, min_vertices=2, max_vertices=4, min_px=4, max_px=12)


def _u(*parts: str) -> str:
    text = "concat_ws('|', '222', k, a, " + ", ".join(parts) + ")"
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _walk(v: int) -> str:
    step = lambda axis, n: f"CAST(floor({_u('s', str(v), repr(axis))} * (2 * ({n} // 3) + 1)) AS BIGINT) - {n} // 3"
    return f"SELECT *, least(w - 1, greatest(0, x{v - 1} + {step('x', 'w')})) AS x{v}, least(h - 1, greatest(0, y{v - 1} + {step('y', 'h')})) AS y{v}"


BRUSH_SQL = fx.PIXELS_SQL + f""",
  att AS (SELECT k, w, h, t.a FROM slides, unnest(range(0, 5)) AS t(a)),
  strokes AS (SELECT att.*, t.s, 2 + CAST(floor({_u('t.s', "'v'")} * 3) AS BIGINT) AS c, greatest(1, (4 + CAST(floor({_u('t.s', "'w'")} * 9) AS BIGINT)) // 2) AS rad,
    CAST(floor({_u('t.s', '0', "'x'")} * w) AS BIGINT) AS x0, CAST(floor({_u('t.s', '0', "'y'")} * h) AS BIGINT) AS y0
    FROM att, unnest(range(0, 1 + CAST(floor({_u("'n'")} * 2) AS BIGINT))) AS t(s)),
  walked AS ({_walk(3)} FROM ({_walk(2)} FROM ({_walk(1)} FROM strokes) q1) q2),
  segs AS (SELECT k, a, rad, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM walked UNION ALL SELECT k, a, rad, x1, y1, x2, y2 FROM walked WHERE c >= 3 UNION ALL SELECT k, a, rad, x2, y2, x3, y3 FROM walked WHERE c >= 4),
  painted AS (SELECT DISTINCT k, a, x, y, tissue FROM (SELECT s.*, p.x, p.y, (p.r < 235 OR p.g < 235 OR p.b < 235) AS tissue, bx - ax AS dx, by_ - ay AS dy, p.x - ax AS px, p.y - ay AS py FROM segs s JOIN (SELECT k, x, y, r, g, b FROM pixels) p USING (k)) q
    WHERE (px * dx + py * dy > 0 AND px * dx + py * dy < dx * dx + dy * dy AND (px * dy - py * dx) * (px * dy - py * dx) <= rad * rad * (dx * dx + dy * dy)) OR px * px + py * py <= rad * rad OR (x - bx) * (x - bx) + (y - by_) * (y - by_) <= rad * rad),
  tried AS (SELECT k, a, count(*) AS n_on, count(*) FILTER (tissue) AS n_tissue FROM painted GROUP BY k, a)
"""


@check("brush_candidates", f"WITH {BRUSH_SQL} SELECT k, CAST(a AS INT) AS attempt, n_on, n_on / CAST(w * h AS DOUBLE) BETWEEN 0.12 AND 0.40 AS in_band FROM tried JOIN slides USING (k)")
def brush_candidates(spark, sf):
    tried = masks.brush_attempts(fx.rgb_blocks(spark, sf, 512), BRUSH)
    return as_k(tried).select("k", "attempt", "n_on", (F.col("n_on") / F.col("n_px")).between(BRUSH.min_area, BRUSH.max_area).alias("in_band"))


@check("random_mask", f"""WITH {BRUSH_SQL}, best AS (SELECT k, min(a) AS a FROM tried JOIN slides USING (k) WHERE n_on / CAST(w * h AS DOUBLE) BETWEEN 0.12 AND 0.40 AND n_tissue / CAST(n_on AS DOUBLE) >= 0.6 GROUP BY k),
  fallback AS (SELECT p.k, count(*) AS n_on FROM pixels p WHERE (x - w // 2) * (x - w // 2) * greatest(8, h // 6) * greatest(8, h // 6) + (y - h // 2) * (y - h // 2) * greatest(8, w // 6) * greatest(8, w // 6) <= greatest(8, w // 6) * greatest(8, w // 6) * greatest(8, h // 6) * greatest(8, h // 6) GROUP BY p.k)
  SELECT s.k, CAST(coalesce(best.a, -1) AS INT) AS attempt, coalesce(t.n_on, f.n_on) AS n_on, best.a IS NULL AS fallback FROM slides s LEFT JOIN best USING (k) LEFT JOIN tried t ON t.k = s.k AND t.a = best.a LEFT JOIN fallback f ON f.k = s.k""")
def random_mask(spark, sf):
    made = masks.random_masks(masks.tissue(fx.rgb_blocks(spark, sf, 512)), BRUSH)
    return as_k(made).select("k", "attempt", "n_on", "fallback")


LANCZOS = "CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END"


@check("source_inputs", f"""WITH {COVER}, px AS (SELECT m.k, m.tile_y, m.tile_x, p.y - m.tile_y AS y, p.x - m.tile_x AS x, {T} AS w, {T} AS h, r, g, b, m_ FROM (SELECT k, tile_y, tile_x, CAST(tile_y + dy.d AS BIGINT) AS y, CAST(tile_x + dx.d AS BIGINT) AS x FROM mined, unnest(range(0, {T})) AS dy(d), unnest(range(0, {T})) AS dx(d)) m
    JOIN (SELECT k, x, y, r, g, b, CASE WHEN cid > 0 THEN 255 ELSE 0 END AS m_ FROM pixels) p ON p.k = m.k AND p.x = m.x AND p.y = m.y),
  {weights_sql('wx', f'SELECT {T} AS n_in, 16 AS n_out', fn=LANCZOS, reach='3')}, wy AS (SELECT * FROM wx),
  {resize_sql('px', 'o', '16', '16', ('r', 'g', 'b', 'm_'), 'k, tile_y, tile_x')}, rgb AS ({digest_sql('o', 'k, tile_y, tile_x')}), msk AS (SELECT k, tile_y, tile_x, CAST(sum(m_) AS BIGINT) AS mask_sum FROM o GROUP BY ALL)
  SELECT rgb.*, mask_sum FROM rgb JOIN msk USING (k, tile_y, tile_x)""")
def source_inputs(spark, sf):
    """Model inputs: image and mask cropped to the clamped tile box, then resized together."""
    from tessella.plans.patches import source_inputs as load

    keys = ["image_id", "tile_y", "tile_x"]
    tiles = mined(spark, sf).select(*keys, "tile_size", "tile_w", "tile_h")
    frames = fx.slides(spark, sf).select(F.col("k").alias("image_id"), "w", "h")
    image, mask = load(tiles, frames, fx.rgb_blocks(spark, sf), fx.mask_blocks(spark, sf), B, 16, 16)
    total = blocks.digest(mask, keys=keys).select(*keys, F.col("sum_v").alias("mask_sum"))
    return as_k(blocks.digest(image, keys=keys).join(total, keys))
