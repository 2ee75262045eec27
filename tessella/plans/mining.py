"""Tile mining: coverage band, per-image cap, white filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import tiles as TL


@dataclass(frozen=True)
class Mining:
    """Parameters of tile mining."""

    size: int = 512
    stride: int = 64
    min_cover: float = 0.15
    max_cover: float = 0.95
    per_image: int = 250
    mode: str = "random"
    seed: int = 222
    max_white: float = 1.0
    white_at: int = 235
    total: int = 0


def capped_tiles(images: DataFrame, mask_blocks: DataFrame, p: Mining, test=lambda a: a > 0, dtype="uint8") -> DataFrame:
    """Tiles of usable images whose mask coverage lies in the band, at most so many per image.

    An image is usable as a whole or not at all, so the cap may come first; then only capped tiles meet the image table.
    """
    cover = TL.mask_coverage(mask_blocks, p.size, p.stride, test, dtype, skip_zero=p.min_cover > 0)
    banded = cover.where(F.col("tile_mask_coverage").between(p.min_cover, p.max_cover))
    return TL.cap_per_image(banded, p.per_image, p.mode, p.seed).join(images, "image_id")


def selected_tiles(images: DataFrame, mask_blocks: DataFrame, rgb_blocks: DataFrame, p: Mining,
                   test=lambda a: a > 0, dtype="uint8") -> DataFrame:
    """Capped tiles with their white content (NULL when the white filter is off), before the filter."""
    capped = capped_tiles(images, mask_blocks, p, test, dtype)
    if p.max_white >= 1.0:
        return capped.withColumn("tile_white_frac", F.lit(None).cast("double"))
    return TL.white_content(rgb_blocks, capped, p.size, p.stride, p.white_at).drop("n_white")


def mine_tiles(images: DataFrame, mask_blocks: DataFrame, rgb_blocks: DataFrame, p: Mining = Mining(),
               test=lambda a: a > 0, dtype="uint8") -> DataFrame:
    """The tile index.  ``images`` holds ``image_id, stem`` and any columns to carry.

    The cap comes before the white filter on purpose: the cap decides which tiles are looked at, the
    filter only removes.
    """
    from tessella.operators.sampling import exact_sample

    picked = selected_tiles(images, mask_blocks, rgb_blocks, p, test, dtype)
    if p.max_white < 1.0:
        picked = picked.where(F.col("tile_white_frac") <= p.max_white)
    out = picked.select(
        "*",
        F.lit(p.size).alias("tile_size"),
        F.lit(p.size).alias("tile_w"),
        F.lit(p.size).alias("tile_h"),
        F.format_string(f"%s__x%05d_y%05d_s{p.size}.png", "stem", "tile_x", "tile_y").alias("filename"),
    )
    if p.total > 0:
        out = exact_sample(out, p.total, p.seed, ["filename"])
    return out


def mining_funnel(images: DataFrame, selected: DataFrame, p: Mining) -> DataFrame:
    """Counters: images too small, tiles before the white filter, dropped by it, kept."""
    small = images.agg(F.count_if((F.col("w") < p.size) | (F.col("h") < p.size)).alias("skipped_small"))
    dropped = F.coalesce(F.col("tile_white_frac") > p.max_white, F.lit(False)) if p.max_white < 1 else F.lit(False)
    tiles = selected.agg(
        F.count("*").alias("selected_before_white"),
        F.count_if(dropped).alias("dropped_by_white"),
        F.count_if(~dropped).alias("kept"),
    )
    both = small.unionByName(tiles, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


def tile_statistics(tiles: DataFrame) -> DataFrame:
    """Summary of a tile index.

    Coverage and white content are multiples of ``1 / size**2``, so the exact percentile keeps at most
    ``size**2 + 1`` distinct values per task, whatever the number of tiles.
    """
    return tiles.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("image_id").alias("unique_source_images"),
        F.avg("tile_mask_coverage").alias("coverage_mean"),
        F.percentile("tile_mask_coverage", F.lit(0.5)).alias("coverage_median"),
        F.percentile("tile_mask_coverage", F.lit(0.25)).alias("coverage_p25"),
        F.percentile("tile_mask_coverage", F.lit(0.75)).alias("coverage_p75"),
        F.avg("tile_white_frac").alias("white_frac_mean"),
        F.percentile("tile_white_frac", F.lit(0.5)).alias("white_frac_median"),
    )
