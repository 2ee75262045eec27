"""Tile mining queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check
from tessella.operators import sampling, tiles
from tessella.plans import mining

T, S = fx.TILE, fx.STRIDE
POSITIONS = f"""
positions AS (
  SELECT k, w, h, stem, list_sort(list_distinct(list_concat(range(0, w - {T} + 1, {S}), [w - {T}]))) AS xs,
    list_sort(list_distinct(list_concat(range(0, h - {T} + 1, {S}), [h - {T}]))) AS ys
  FROM slides WHERE w >= {T} AND h >= {T}
),
grid AS (SELECT k, w, h, stem, CAST(ux.x AS INT) AS tile_x, CAST(uy.y AS INT) AS tile_y FROM positions, unnest(xs) AS ux(x), unnest(ys) AS uy(y))
"""
FIRST = fx.PIXELS_SQL + "," + POSITIONS
COVER = FIRST + f""",
cover AS (
  SELECT g.k, g.stem, tile_y, tile_x, CAST(count(*) FILTER (cid > 0) AS BIGINT) AS n_fg,
    CAST(count(*) FILTER (r >= 235 AND g >= 235 AND b >= 235) AS BIGINT) AS n_white
  FROM (SELECT k, stem, tile_y, tile_x, CAST(tile_y + dy.d AS BIGINT) AS y, CAST(tile_x + dx.d AS BIGINT) AS x
        FROM grid, unnest(range(0, {T})) AS dy(d), unnest(range(0, {T})) AS dx(d)) g
  JOIN (SELECT k, x, y, cid, r, g, b FROM pixels) p ON p.k = g.k AND p.x = g.x AND p.y = g.y
  GROUP BY ALL
),
usable AS (SELECT s.k FROM slides s JOIN masks m USING (stem) WHERE s.w = m.w AND s.h = m.h),
banded AS (SELECT cover.*, n_fg / {T * T}.0 AS coverage FROM cover WHERE n_fg / {T * T}.0 BETWEEN 0.15 AND 0.95),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', '222', k, tile_y, tile_x)), tile_y, tile_x) AS rn,
    row_number() OVER (PARTITION BY k ORDER BY coverage DESC, tile_y, tile_x) AS rn_top
  FROM banded SEMI JOIN usable USING (k)
),
picked AS (SELECT *, n_white / {T * T}.0 AS white FROM ranked WHERE rn <= 6),
mined AS (SELECT * FROM picked WHERE white <= 0.30)
"""


def usable_images(spark, sf):
    """Slides that have a mask of their own size."""
    s, m = fx.slides(spark, sf), fx.masks(spark, sf)
    fits = m.select("stem", F.col("w").alias("mw"), F.col("h").alias("mh"))
    return s.join(fits, "stem").where("w = mw AND h = mh").select(F.col("k").alias("image_id"), "stem", "w", "h")


def mined(spark, sf):
    return mining.mine_tiles(
        usable_images(spark, sf), fx.class_blocks(spark, sf), fx.rgb_blocks(spark, sf), fx.MINING, dtype="int8"
    )


def selected(spark, sf):
    return mining.selected_tiles(
        usable_images(spark, sf), fx.class_blocks(spark, sf), fx.rgb_blocks(spark, sf), fx.MINING, dtype="int8"
    )


@check("axis_positions", f"WITH {fx.SLIDES_SQL}, {POSITIONS} SELECT s.k, coalesce(array_to_string(xs, ','), '') AS xs, coalesce(array_to_string(ys, ','), '') AS ys "
       f"FROM slides s LEFT JOIN (SELECT k, list_sort(list_distinct(list_concat(range(0, w - {T} + 1, {S}), [w - {T}]))) AS xs FROM slides WHERE w >= {T}) a USING (k) "
       f"LEFT JOIN (SELECT k, list_sort(list_distinct(list_concat(range(0, h - {T} + 1, {S}), [h - {T}]))) AS ys FROM slides WHERE h >= {T}) b USING (k)")
def axis_positions(spark, sf):
    join = lambda c: F.array_join(tiles.axis_positions(F.col(c), T, S).cast("array<string>"), ",")
    return fx.slides(spark, sf).select("k", join("w").alias("xs"), join("h").alias("ys"))


@check("tile_grid", f"WITH {fx.SLIDES_SQL}, {POSITIONS} SELECT k, tile_y, tile_x FROM grid")
def tile_grid(spark, sf):
    return tiles.tile_grid(fx.slides(spark, sf), T, S).select("k", "tile_y", "tile_x")


@check("tile_coverage", f"WITH {COVER} SELECT k, tile_y, tile_x, n_fg, round(coverage, 6) AS coverage FROM banded")
def tile_coverage(spark, sf):
    cover = tiles.mask_coverage(fx.class_blocks(spark, sf), T, S, dtype="int8").where("tile_mask_coverage BETWEEN 0.15 AND 0.95")
    return cover.select(F.col("image_id").alias("k"), "tile_y", "tile_x", "n_fg", F.round("tile_mask_coverage", 6).alias("coverage"))


@check("tile_white", f"WITH {COVER} SELECT k, tile_y, tile_x, round(white, 6) AS white FROM mined")
def tile_white(spark, sf):
    kept = selected(spark, sf).where("tile_white_frac <= 0.30")
    return kept.select(F.col("image_id").alias("k"), "tile_y", "tile_x", F.round("tile_white_frac", 6).alias("white"))


@check("tile_index", f"""WITH {COVER} SELECT k, concat(stem, '__x', lpad(CAST(tile_x AS VARCHAR), 5, '0'), '_y', lpad(CAST(tile_y AS VARCHAR), 5, '0'), '_s{T}.png') AS filename,
  tile_x, tile_y, round(coverage, 6) AS tile_mask_coverage, round(white, 6) AS tile_white_frac FROM mined ORDER BY k, tile_y, tile_x""")
def tile_index(spark, sf):
    """The flagship: grid, coverage band, per-image cap, white filter, ordered output."""
    return (
        mined(spark, sf)
        .select(
            F.col("image_id").alias("k"), "filename", "tile_x", "tile_y",
            F.round("tile_mask_coverage", 6).alias("tile_mask_coverage"), F.round("tile_white_frac", 6).alias("tile_white_frac"),
        )
        .orderBy("k", "tile_y", "tile_x")
    )


@check("tile_name", f"""WITH {fx.SLIDES_SQL}, {POSITIONS} SELECT concat(stem, '__x', lpad(CAST(tile_x AS VARCHAR), 5, '0'), '_y', lpad(CAST(tile_y AS VARCHAR), 5, '0'), '_s{T}.png') AS filename FROM grid""")
def tile_name(spark, sf):
    return tiles.tile_grid(fx.slides(spark, sf), T, S).select(
        F.format_string(f"%s__x%05d_y%05d_s{T}.png", "stem", "tile_x", "tile_y").alias("filename")
    )


@check("cap_top", f"WITH {COVER} SELECT k, tile_y, tile_x, round(coverage, 6) AS coverage FROM ranked WHERE rn_top <= 6")
def cap_top(spark, sf):
    params = replace(fx.MINING, mode="top_coverage")
    top = mining.capped_tiles(usable_images(spark, sf), fx.class_blocks(spark, sf), params, dtype="int8")
    return top.select(F.col("image_id").alias("k"), "tile_y", "tile_x", F.round("tile_mask_coverage", 6).alias("coverage"))


@check("cap_random", f"WITH {COVER} SELECT k, tile_y, tile_x FROM ranked WHERE rn <= 6")
def cap_random(spark, sf):
    capped = mining.capped_tiles(usable_images(spark, sf), fx.class_blocks(spark, sf), fx.MINING, dtype="int8")
    return capped.select(F.col("image_id").alias("k"), "tile_y", "tile_x")


@check("cap_global", f"""WITH {fx.SLIDES_SQL}, {POSITIONS} SELECT k, tile_y, tile_x FROM grid
  QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', '222', k, tile_y, tile_x)), k, tile_y, tile_x) <= 1000""")
def cap_global(spark, sf):
    grid = tiles.tile_grid(fx.slides(spark, sf), T, S)
    return sampling.exact_sample(grid, 1000, 222, ["k", "tile_y", "tile_x"]).select("k", "tile_y", "tile_x")


@check("tile_stats", f"""WITH {COVER} SELECT count(*) AS n_rows, count(DISTINCT k) AS unique_source_images, round(avg(coverage), 6) AS coverage_mean,
  round(quantile_cont(coverage, 0.5), 6) AS coverage_median, round(quantile_cont(coverage, 0.25), 6) AS coverage_p25,
  round(quantile_cont(coverage, 0.75), 6) AS coverage_p75, round(avg(white), 6) AS white_frac_mean,
  round(quantile_cont(white, 0.5), 6) AS white_frac_median FROM (SELECT k, CAST(coverage AS DOUBLE) AS coverage, CAST(white AS DOUBLE) AS white FROM mined)""")
def tile_stats(spark, sf):
    stats = mining.tile_statistics(mined(spark, sf))
    return stats.select(*[c if c.startswith(("n_", "unique")) else F.round(c, 6).alias(c) for c in stats.columns])


@check("tile_funnel", f"""WITH {COVER} SELECT (SELECT count(*) FROM slides SEMI JOIN usable USING (k) WHERE w < {T} OR h < {T}) AS skipped_small,
  count(*) AS selected_before_white, count(*) FILTER (white > 0.30) AS dropped_by_white, count(*) FILTER (white <= 0.30) AS kept FROM picked""")
def tile_funnel(spark, sf):
    return mining.mining_funnel(usable_images(spark, sf), selected(spark, sf), fx.MINING)


@check("size_gate", f"""WITH {fx.SLIDES_SQL} SELECT s.k, CASE WHEN m.stem IS NULL THEN 'missing_mask' WHEN s.w <> m.w OR s.h <> m.h THEN 'size_mismatch' ELSE 'ok' END AS status
  FROM slides s LEFT JOIN masks m USING (stem)""")
def size_gate(spark, sf):
    from tessella.operators.joins import size_status

    m = fx.masks(spark, sf).select("stem", F.col("w").alias("mask_w"), F.col("h").alias("mask_h"))
    return size_status(fx.slides(spark, sf).join(m, "stem", "left")).select("k", "status")
