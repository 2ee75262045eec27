"""Activation maps and the masks cut from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocks import BLOCK_FIELDS, PIECE_FIELDS, assemble, block_row, cut, map_blocks, piece, piece_rows, pixels, spread_over_blocks
from tessella.operators.resample import letterbox_geometry, resize_linear
from tessella.session import pin


def fixed(v: np.ndarray, digits: int) -> np.ndarray:
    """Round to a fixed number of digits, halves up with slack for the last bits, so that equal heat compares equal."""
    scale = 10.0**digits
    return np.floor(v * scale + 0.501) / scale


def activation_map(channels: DataFrame) -> DataFrame:
    """Channel-weighted activation per pixel, scaled to 0..1 per image: ``(image_id, pixel, v)``.

    ``channels`` has one row per image and channel with ``activation`` and ``gradient`` arrays; the channel weight is
    the mean gradient.  Contributions are summed on the map side before they are shuffled by pixel.
    """
    weight = F.aggregate("gradient", F.lit(0.0), lambda a, v: a + v) / F.size("gradient")
    parts = channels.select("image_id", F.posexplode(F.transform("activation", lambda v: v * weight)).alias("pixel", "part"))
    raw = parts.groupBy("image_id", "pixel").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("v"))
    span = raw.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    top = F.col("_hi") - F.col("_lo")
    scaled = (F.col("v") - F.col("_lo")) / F.when(top == 0, 1.0).otherwise(top)
    return raw.join(span, "image_id").select("image_id", "pixel", scaled.alias("v"))


def heat_blocks(cam: DataFrame, height: int, width: int, digits: int = 6) -> DataFrame:
    """Network-resolution maps (``height x width`` cells, a bounded handful per image) as block images of doubles."""
    rows = cam.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pixel", "v"))).alias("cells"))

    def kernel(r):
        arr = np.zeros(height * width)
        for c in r["cells"]:
            arr[c["pixel"]] = c["v"]
        b = {"by": 0, "bx": 0, "img_h": height, "img_w": width}
        return block_row(b, 0, 0, fixed(arr, digits).reshape(height, width))

    return map_blocks(rows, kernel, BLOCK_FIELDS)


def unpad_box(img_h: int, img_w: int, size: int, heat_h: int, heat_w: int) -> tuple[int, int, int, int]:
    """The part of a heat map that shows the image rather than letterbox padding: ``(y0, x0, y1, x1)``."""
    new_h, new_w, y0, x0 = letterbox_geometry(img_h, img_w, size)
    sy, sx = heat_h / size, heat_w / size
    top, left = round(y0 * sy), round(x0 * sx)
    return top, left, min(heat_h, top + round(new_h * sy)), min(heat_w, left + round(new_w * sx))


def unpad(heat: DataFrame, images: DataFrame, block: int, size: int, digits: int = 6) -> DataFrame:
    """Crop the padding and scale back to the original frame; ``images`` gives ``image_id, w, h``."""
    sized = heat.join(images.select("image_id", F.col("h").alias("orig_h"), F.col("w").alias("orig_w")), "image_id")

    def crop(b):
        y0, x0, y1, x1 = unpad_box(b["orig_h"], b["orig_w"], size, b["img_h"], b["img_w"])
        got = cut(b, pixels(b, np.float64), y0, x0, y1, x1)
        if got is None:
            return None
        return piece_rows([(0, 0, 0, 0, y1 - y0, x1 - x0, y1 - y0, x1 - x0, 1)], [piece(got[0] - y0, got[1] - x0, np.ascontiguousarray(got[2]))])

    keys = ("image_id", "orig_h", "orig_w")
    cropped = assemble(map_blocks(sized, crop, PIECE_FIELDS, keys), np.float64, keys=keys)
    grown = resize_linear(cropped, block, lambda b: (b["orig_h"], b["orig_w"]), antialias=False, dtype=np.float64,
                          finish=lambda v: fixed(v, digits), keys=keys)
    return grown.drop("orig_h", "orig_w")


def value_counts(heat: DataFrame) -> DataFrame:
    """Distinct values per image with their number."""

    def kernel(b):
        v, n = np.unique(pixels(b, np.float64), return_counts=True)
        return {"v": v, "n": n.astype(np.int64)}

    return map_blocks(heat, kernel, "v double, n bigint").groupBy("image_id", "v").agg(F.sum("n").alias("n"))


def exact_quantiles(counts: DataFrame, key: str, probs: Sequence[float], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Exact linear-interpolated quantiles ``(key, prob, q)`` of counted values ``(key, v, n)``, without ever sorting a
    whole group.

    Values fall into 1024 equal bins, the bins holding the wanted order statistics are split into 1024 finer ones,
    and only the values of those are ranked; every window sees at most one bin.  The counts are read twice, so they are
    pinned once.
    """

    def bin_of(bits):
        scaled = (F.col("v") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(1 << bits))
        return F.least(F.floor(scaled), F.lit((1 << bits) - 1)).cast("bigint")

    def before(size, *group):
        return F.sum(size).over(Window.partitionBy(*group).orderBy("_bin")) - F.col(size)

    cells = pin(counts).withColumn("_bin", bin_of(10))
    spans = (
        cells.groupBy(key, "_bin").agg(F.sum("n").alias("_size"))
        .withColumn("_before", before("_size", key)).withColumn("_total", F.sum("_size").over(Window.partitionBy(key)))
    )
    asked = spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    place = (F.col("_total") - 1) * F.col("prob")
    ends = F.array(F.struct(F.lit("lo").alias("side"), F.floor(place).alias("at")), F.struct(F.lit("hi").alias("side"), F.ceil(place).alias("at")))
    target = [key, "prob", "_frac", "side"]
    within = (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_size"))
    offset = (F.col("at") - F.col("_before")).alias("at")
    coarse = asked.select("*", (place - F.floor(place)).alias("_frac"), F.explode(ends).alias("_e")).select("*", "_e.*").where(within)

    cells = cells.join(coarse.select(*target, "_bin", offset), [key, "_bin"]).withColumn("_bin", bin_of(20))
    spans = cells.groupBy(*target, "at", "_bin").agg(F.sum("n").alias("_size")).withColumn("_before", before("_size", *target))
    fine = spans.where(within).select(*target, "_bin", offset)

    upto = F.sum("n").over(Window.partitionBy(*target).orderBy("v"))
    ranked = cells.drop("at").join(fine, [*target, "_bin"]).withColumn("_upto", upto)
    found = ranked.where((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("n")))
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("v")))
    pairs = found.groupBy(key, "prob", "_frac").agg(side("lo").alias("_a"), side("hi").alias("_b"))
    return pairs.select(key, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("q"))


def mask_thresholds(counts: DataFrame, quantile: float = 0.85, min_area: float = 0.05, max_area: float = 0.5,
                    low: float = 0.75, high: float = 0.95) -> DataFrame:
    """Cut level per image: the asked quantile; the low one when too little is above it; the high one when too much is."""
    q = exact_quantiles(counts, "image_id", [quantile, low, high])
    cuts = q.groupBy("image_id").agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for p, n in ((quantile, "_q"), (low, "_low"), (high, "_high"))])
    above = lambda c: F.sum(F.when(F.col("v") >= F.col(c), F.col("n")).otherwise(0)) / F.sum("n")
    areas = counts.join(cuts, "image_id").groupBy("image_id", "_q", "_low", "_high").agg(above("_q").alias("_area"), above("_low").alias("_low_area"))
    first = F.when(F.col("_area") < min_area, F.col("_low")).otherwise(F.col("_q"))
    area = F.when(F.col("_area") < min_area, F.col("_low_area")).otherwise(F.col("_area"))
    return areas.select("image_id", F.when(area > max_area, F.col("_high")).otherwise(first).alias("cut"))


BINS = 4096  # of the first pass over heat


def heat_cuts(heat: DataFrame, images: DataFrame, block: int, quantile: float = 0.85, min_area: float = 0.05, max_area: float = 0.5,
              low: float = 0.75, high: float = 0.95) -> DataFrame:
    """Cut level per image as ``mask_thresholds`` gives it, by two passes over heat in [0, 1] and without a row per pixel.

    The first pass counts ``BINS`` equal bins per block; sums over them tell which bins hold the wanted order statistics. The second
    emits distinct values of those bins only, with their number. Areas above a cut follow from the same running sums.
    """

    def binned(values):
        return np.minimum((values * BINS).astype(np.int64), BINS - 1)

    def histogram(b):
        n = np.bincount(binned(pixels(b, np.float64)).ravel(), minlength=BINS)
        at = np.flatnonzero(n)
        return {"bin": at.astype(np.int32), "n": n[at]}

    bins = map_blocks(heat, histogram, "bin int, n bigint").groupBy("image_id", "bin").agg(F.sum("n").alias("n"))
    by_bin = Window.partitionBy("image_id")  # BINS rows of an image at most
    spans = bins.select("image_id", "bin", "n", (F.sum("n").over(by_bin.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(by_bin).alias("total"))
    probs = F.explode(F.array(*[F.lit(float(p)) for p in (quantile, low, high)])).alias("prob")
    place = (F.col("total") - 1) * F.col("prob")
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.floor(place).alias("at")), F.struct(F.lit("b").alias("end"), F.ceil(place).alias("at")))).alias("e")
    asked = spans.select("*", probs).select("*", (place - F.floor(place)).alias("frac"), ends).select("image_id", "bin", "n", "before", "total", "prob", "frac", "e.*")
    wanted = pin(asked.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).drop("n"))  # six rows an image

    frames = images.select("image_id", F.col("h").alias("img_h"), F.col("w").alias("img_w"))
    lists = wanted.groupBy("image_id").agg(F.collect_set("bin").alias("bins"))
    listed = spread_over_blocks(frames.join(lists, "image_id"), block).drop("img_h", "img_w")

    def values(b):
        flat = pixels(b, np.float64).ravel()
        v, n = np.unique(flat[np.isin(binned(flat), b["bins"])], return_counts=True)
        return {"bin": binned(v).astype(np.int32), "v": v, "n": n.astype(np.int64)}

    found = map_blocks(heat.join(listed, ["image_id", "by", "bx"]), values, "bin int, v double, n bigint").groupBy("image_id", "bin", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("image_id", "bin").orderBy("v"))
    placed = found.withColumn("upto", upto).join(wanted, ["image_id", "bin"]).withColumn("first", F.col("before") + F.col("upto") - F.col("n"))
    hit = placed.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("before") + F.col("upto")))
    pick = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    pairs = hit.groupBy("image_id", "prob", "frac", "total").agg(
        pick("a", "v").alias("a"), pick("b", "v").alias("b"), pick("a", "first").alias("below"), F.max(F.when(F.col("end") == "a", F.col("before") + F.col("upto"))).alias("through")
    )
    q = F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")
    under = F.when(F.col("q") > F.col("a"), F.col("through")).otherwise(F.col("below"))  # no value lies between the two ends
    each = pairs.withColumn("q", q).select("image_id", "prob", "q", (1 - under / F.col("total")).alias("area"))
    at = lambda p, c: F.max(F.when(F.col("prob") == float(p), F.col(c)))
    wide = each.groupBy("image_id").agg(at(quantile, "q").alias("q"), at(low, "q").alias("lo"), at(high, "q").alias("hi"), at(quantile, "area").alias("area"), at(low, "area").alias("lo_area"))
    little = F.col("area") < min_area
    first = F.when(little, F.col("lo")).otherwise(F.col("q"))
    area = F.when(little, F.col("lo_area")).otherwise(F.col("area"))
    return wide.select("image_id", F.when(area > max_area, F.col("hi")).otherwise(first).alias("cut"))


def cut_masks(heat: DataFrame, cuts: DataFrame, images: DataFrame, block: int) -> DataFrame:
    """Masks (0 / 255) of heat at or above each image's cut level."""
    frames = images.select("image_id", F.col("h").alias("img_h"), F.col("w").alias("img_w"))
    levels = spread_over_blocks(frames.join(cuts, "image_id"), block).drop("img_h", "img_w")

    def kernel(b):
        return block_row(b, b["y0"], b["x0"], ((pixels(b, np.float64) >= b["cut"]) * 255).astype(np.uint8))

    return map_blocks(heat.join(levels, ["image_id", "by", "bx"]), kernel, BLOCK_FIELDS)
