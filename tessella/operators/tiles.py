"""Tile grid, mask coverage, white content and per-image caps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import CLASS_NAMES, coarse_by_classes
from tessella.operators import cells


def axis_positions(length: Column, size: int, stride: int) -> Column:
    """Tile origins along one axis: multiples of the stride plus the flush-right origin; empty if too short."""
    last = (length - F.lit(size)).cast("int")
    return F.when(
        length >= size,
        F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)),
    ).otherwise(F.array().cast("array<int>"))


def tile_grid(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Every tile origin of every image that is at least one tile large."""
    return images.withColumn("tile_y", F.explode(axis_positions(F.col("h"), size, stride))).withColumn(
        "tile_x", F.explode(axis_positions(F.col("w"), size, stride))
    )


def tile_counts(blocks: DataFrame, size: int, stride: int, test, name: str, dtype=np.uint8, skip_zero: bool = False) -> DataFrame:
    """Pixels per tile for which ``test(array)`` holds: ``(image_id, tile_y, tile_x, <name>)``.

    Blocks send counts of breakpoint cells, about a cell per square stride, and tiles are sums of cells; pixel bytes never move.
    ``skip_zero`` leaves out tiles without any.
    """
    found = cells.cell_counts(blocks, size, stride, test, dtype=dtype, skip_zero=skip_zero)
    return cells.tile_sums(found, size, stride, name=name, skip_zero=skip_zero)


def mask_coverage(mask_blocks: DataFrame, size: int, stride: int, test=lambda a: a > 0, dtype=np.uint8, skip_zero: bool = False) -> DataFrame:
    """Share of foreground per tile."""
    return tile_counts(mask_blocks, size, stride, test, "n_fg", dtype, skip_zero).withColumn(
        "tile_mask_coverage", F.col("n_fg") / F.lit(size * size)
    )


def white_content(rgb_blocks: DataFrame, tiles: DataFrame, size: int, stride: int, threshold: int) -> DataFrame:
    """``tiles`` with ``n_white`` and ``tile_white_frac``, the share of near-white pixels (all channels at or above the threshold).

    Rows are made for these tiles only, however many more the grid has.
    """
    bright = lambda a: (a[:, :, 0] >= threshold) & (a[:, :, 1] >= threshold) & (a[:, :, 2] >= threshold)
    white = cells.cell_counts(rgb_blocks, size, stride, bright, skip_zero=True)
    return cells.asked_sums(white, tiles, size, stride, "n_white").withColumn("tile_white_frac", F.col("n_white") / F.lit(size * size))


def tile_classes(class_blocks: DataFrame, size: int, stride: int, classes: int = len(CLASS_NAMES), dtype=np.int8) -> DataFrame:
    """``image_id, tile_y, tile_x, counts``: pixels of each class 0 to ``classes - 1`` of every tile, all classes in one pass."""
    found = cells.cell_counts(class_blocks, size, stride, lambda a: a, classes, dtype)
    return cells.tile_sums(found, size, stride, classes, "counts")


def majority_label(tiles: DataFrame, size: int, least: float = 0.6) -> DataFrame:
    """``tiles`` (with ``counts`` by class) with ``majority`` and ``majority_share``, and ``coarse_label``.

    The majority is the class of most pixels if its share of the whole tile, pixels of unknown classes included, is above ``least``;
    else it is NULL, though the share is given. Equal counts go to the smaller class, which matters at shares up to a half only.
    ``coarse_label`` is positive when any positive class is present, be it a single pixel.
    """
    most = F.array_max("counts")
    share = most / F.lit(size * size)
    named = F.when(share > least, (F.array_position("counts", most) - 1).cast("int"))
    present = F.filter(F.transform("counts", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    return tiles.withColumns({"majority": named, "majority_share": share, "coarse_label": coarse_by_classes(present)})


def draw_key(seed, *parts: str) -> Column:
    """Seeded, engine-independent draw order: md5 over the seed and the key parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def cap_per_image(tiles: DataFrame, limit: int, mode: str, seed: int) -> DataFrame:
    """At most ``limit`` tiles per image; ``limit <= 0`` keeps all.

    The rank filter plans as a partial and a final group limit, so at most ``limit`` rows per image and
    map task are shuffled, however large one image is.
    """
    if limit <= 0:
        return tiles
    order = (
        [F.desc("tile_mask_coverage"), "tile_y", "tile_x"]
        if mode == "top_coverage"
        else [draw_key(seed, "image_id", "tile_y", "tile_x"), "tile_y", "tile_x"]
    )
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
    return tiles.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
