"""Patch edit and quality control, from regions to judged edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import boxes as bx
from tessella.functions import seeds
from tessella.operators import blend, quality, resample
from tessella.operators.blocks import crop_tiles
from tessella.session import pin

# Descriptor of each coarse label in edit prompts, and of any other label
EDIT_DESCRIPTORS = {
    "cancer": "malignant skin histology pattern with dysplastic morphology",
    "non_cancer": "normal skin tissue architecture, preserved stratification",
}
OTHER_DESCRIPTOR = "skin histology tissue pattern"


def source_inputs(tiles: DataFrame, images: DataFrame, image_blocks: DataFrame, mask_blocks: DataFrame, block: int, height: int, width: int):
    """Image and mask of each tile, cropped to the clamped box and resized to the model's size. A mask that hasn't its image's size
    belongs to the tile already and is taken whole.

    ``tiles``: ``image_id, tile_y, tile_x, tile_size, tile_w, tile_h``; ``images``: ``image_id, w, h``.
    """
    keys = ["image_id", "tile_y", "tile_x"]
    box = bx.clamp_box(
        bx.crop_box(*[F.col(f"tile_{c}") for c in ("x", "y", "size", "w", "h")]), F.col("w"), F.col("h")
    )
    # coordinates only, and read by both crops: pinned once instead of mined twice
    boxed = pin(tiles.join(images.select("image_id", "w", "h"), "image_id").withColumn("box", box).where("box IS NOT NULL").select(*keys, "w", "h", "box.*"))
    # sizes are read from two columns of the mask blocks
    sizes = mask_blocks.select("image_id", F.col("img_w").alias("_mw"), F.col("img_h").alias("_mh")).distinct()
    shared = (F.col("_mw") == F.col("w")) & (F.col("_mh") == F.col("h"))
    corner = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("_mw"), "y1": F.col("_mh")}
    of_mask = boxed.join(sizes, "image_id").select(*keys, *[F.when(shared, F.col(c)).otherwise(v).alias(c) for c, v in corner.items()])

    def load(boxes, source):
        return resample.resize_crops(crop_tiles(boxes, source, block, keys), height, width, "lanczos", keys)

    return load(boxed.drop("w", "h"), image_blocks), load(of_mask, mask_blocks)


def labelled_crops(tiles: DataFrame, image_blocks: DataFrame, mask_blocks: DataFrame, block: int, keys: Sequence[str]) -> DataFrame:
    """Each tile cut from its image and from the mask of the same size (column ``mask``). Blocks of both meet before tiles are cut, since
    tiles overlap: their crops hold more bytes than the blocks."""
    own = mask_blocks.select("image_id", "by", "bx", F.col("data").alias("mask"))
    return crop_tiles(tiles, image_blocks.join(own, ["image_id", "by", "bx"]), block, keys, "mask")


def edit_plan(patches: DataFrame, template: str, seed_base: int, row: str) -> DataFrame:
    """Prompt and seed of every patch."""
    from tessella.functions.labels import lookup

    known = lookup(F.col("coarse_label"), EDIT_DESCRIPTORS, OTHER_DESCRIPTOR)
    prompt = F.replace(
        F.replace(F.lit(template), F.lit("{token}"), F.col("coarse_label")), F.lit("{descriptor_suffix}"), F.concat(F.lit(", "), known)
    )
    return patches.select("*", prompt.alias("prompt"), seeds.row_seed(seed_base, F.col(row)).alias("seed"))


def judge_edits(original: DataFrame, edited: DataFrame, boxes: DataFrame, block: int, limits: quality.Limits = quality.Limits()) -> DataFrame:
    """Quality metrics and verdict of every edited image."""
    return quality.judge(quality.edit_metrics(quality.edit_counters(original, edited, boxes, block, moments=True)), limits)


def paste_and_judge(original: DataFrame, patches: DataFrame, boxes: DataFrame, block: int, radius: int = 16):
    """Place edited patches, blend them in and judge the result: ``(merged blocks, verdicts)``."""
    placed = blend.place_patches(patches, boxes, block)
    merged = blend.paste_back(original, placed, boxes, block, radius)
    return merged, judge_edits(original, merged, boxes, block)
