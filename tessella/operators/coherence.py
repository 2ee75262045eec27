"""Coherence along the slices of a volume: neighbouring slices, their local similarity outside edits, and trajectories of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.blocks import BLOCK_FIELDS, PIECE_FIELDS, assemble, block_row, map_blocks, piece, pixels, spread_over_blocks
from tessella.operators.sampling import with_position

#: Constants of the structural similarity index, and weights of red, green and blue in a thousandth of grey.
STABLE = (0.01 * 255) ** 2, (0.03 * 255) ** 2
GREY = (299, 587, 114)
UNIT = 10**9  # similarities are summed as whole numbers of this unit, so that sums don't depend on blocks
CHUNK = 4096  # slices of a volume in one task


def slice_pairs(slices: DataFrame) -> DataFrame:
    """``image_id, next_id, img_h, img_w``: each slice and the next one of its volume, with their common frame.

    slices: ``image_id`` (one row each), ``volume_id, slice_index, img_h, img_w``. Equal indices are ordered by ``image_id``; slices without volume
    or index have no neighbours. Positions are dense within a volume, however many tasks it spans.
    """
    rows = slices.where("volume_id IS NOT NULL AND slice_index IS NOT NULL").select("image_id", "volume_id", "slice_index", "img_h", "img_w")
    placed = with_position(rows, ["slice_index", "image_id"], by=["volume_id"])
    after = placed.select("volume_id", (F.col("position") - 1).alias("position"), F.col("image_id").alias("next_id"), F.col("img_h").alias("_h"), F.col("img_w").alias("_w"))
    return placed.join(after, ["volume_id", "position"]).select("image_id", "next_id", F.least("img_h", "_h").alias("img_h"), F.least("img_w", "_w").alias("img_w"))


def grey_blocks(rgb_blocks: DataFrame) -> DataFrame:
    """Blocks of one channel: rounded grey."""

    def kernel(b):
        arr = pixels(b).astype(np.int64)
        return block_row(b, b["y0"], b["x0"], ((arr @ np.array(GREY) + 500) // 1000).astype(np.uint8))

    return map_blocks(rgb_blocks, kernel, BLOCK_FIELDS)


def window_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Sums over all ``size`` x ``size`` windows, from an integral image."""
    area = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    area[1:, 1:] = values.cumsum(0).cumsum(1)
    return area[size:, size:] - area[:-size, size:] - area[size:, :-size] + area[:-size, :-size]


def local_similarity(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Structural similarity of all windows, with the variances of whole populations."""
    n = size * size
    a, b = a.astype(np.int64), b.astype(np.int64)
    sa, sb, saa, sbb, sab = (window_sums(v, size) for v in (a, b, a * a, b * b, a * b))
    ma, mb = sa / n, sb / n
    va, vb, cov = (n * saa - sa * sa) / n**2, (n * sbb - sb * sb) / n**2, (n * sab - sa * sb) / n**2
    return (2 * ma * mb + STABLE[0]) * (2 * cov + STABLE[1]) / ((ma * ma + mb * mb + STABLE[0]) * (va + vb + STABLE[1]))


def slice_similarity(rgb_blocks: DataFrame, slices: DataFrame, boxes: DataFrame, block: int, size: int = 7) -> DataFrame:
    """``image_id, next_id, n_windows, similarity``: mean local similarity of neighbouring slices over the windows of their common frame
    without an edited pixel of either; NULL where there is no such window.

    boxes: ``image_id, y0b, x0b, y1b, x1b``, at most one edit window per image. Every block goes once to each of its image's two pairs, grown at the
    right and below by what windows reach over its edge; both slices of a pair are laid into one block of two channels by a single shuffle.
    """
    pairs = slice_pairs(slices)
    edit = boxes.select("image_id", F.array("y0b", "x0b", "y1b", "x1b").alias("edit"))
    none = F.array(*[F.lit(0)] * 4)
    both = pairs.join(edit, "image_id", "left").join(edit.select(F.col("image_id").alias("next_id"), F.col("edit").alias("next_edit")), "next_id", "left")
    both = both.withColumn("edits", F.concat(F.coalesce("edit", none), F.coalesce("next_edit", none)))
    role = lambda own, n: both.select(F.col(own).alias("image_id"), F.struct("image_id", "next_id", F.lit(n).alias("role"), F.col("img_h").alias("ph"), F.col("img_w").alias("pw"), "edits").alias("role"))
    roles = role("image_id", 0).unionByName(role("next_id", 1)).groupBy("image_id").agg(F.collect_list("role").alias("roles"))
    facts = spread_over_blocks(roles.join(slices.select("image_id", "img_h", "img_w"), "image_id"), block).drop("img_h", "img_w")
    met = grey_blocks(rgb_blocks).join(facts, ["image_id", "by", "bx"])
    names = T.StructType.fromDDL(PIECE_FIELDS).names

    def kernel(b):
        arr = pixels(b)
        out: dict[str, list] = {c: [] for c in ("image_id", "next_id", "edits", *names)}
        for r in b["roles"]:
            h, w = min(b["h"], r["ph"] - b["y0"]), min(b["w"], r["pw"] - b["x0"])
            if h <= 0 or w <= 0:
                continue
            for by in range(max(0, b["y0"] - size + 1) // block, (b["y0"] + h - 1) // block + 1):
                for bx in range(max(0, b["x0"] - size + 1) // block, (b["x0"] + w - 1) // block + 1):
                    y0, x0 = by * block, bx * block
                    y1, x1 = min(r["ph"], y0 + block + size - 1), min(r["pw"], x0 + block + size - 1)
                    ya, xa, yb, xb = max(y0, b["y0"]), max(x0, b["x0"]), min(y1, b["y0"] + h), min(x1, b["x0"] + w)
                    part = np.zeros((yb - ya, xb - xa, 2), np.uint8)
                    part[:, :, r["role"]] = arr[ya - b["y0"] : yb - b["y0"], xa - b["x0"] : xb - b["x0"]]
                    row = (r["image_id"], r["next_id"], r["edits"], by, bx, y0, x0, y1 - y0, x1 - x0, r["ph"], r["pw"], 2, piece(ya, xa, part))
                    for c, v in zip(out, row):
                        out[c].append(v)
        return out if out["by"] else None

    ids = [T.StructField(c, rgb_blocks.schema["image_id"].dataType) for c in ("image_id", "next_id")]
    schema = T.StructType([*ids, T.StructField("edits", T.ArrayType(T.IntegerType())), *T.StructType.fromDDL(PIECE_FIELDS).fields])
    laid = assemble(map_blocks(met, kernel, schema, carry=()), add=True, keys=("image_id", "next_id", "edits"))

    def score(b):
        arr = pixels(b)
        h, w = arr.shape[0] - size + 1, arr.shape[1] - size + 1
        if h <= 0 or w <= 0:
            return {"n": [0], "total": [0]}
        edited = np.zeros(arr.shape[:2], np.int64)
        for y0, x0, y1, x1 in (b["edits"][:4], b["edits"][4:]):
            edited[max(0, y0 - b["y0"]) : max(0, y1 - b["y0"]), max(0, x0 - b["x0"]) : max(0, x1 - b["x0"])] = 1
        free = window_sums(edited, size) == 0
        found = local_similarity(arr[:, :, 0], arr[:, :, 1], size)[free]
        return {"n": [len(found)], "total": [int(np.rint(found * UNIT).astype(np.int64).sum())]}

    shares = map_blocks(laid, score, "n bigint, total bigint", ("image_id", "next_id"))
    sums = shares.groupBy("image_id", "next_id").agg(F.sum("n").alias("n_windows"), F.sum("total").alias("_total"))
    return sums.select("image_id", "next_id", "n_windows", F.when(F.col("n_windows") > 0, F.col("_total") / F.col("n_windows") / UNIT).alias("similarity"))


def slice_steps(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``volume_id, slice_index, value, step, bend``: divided differences of first and second order from each slice to the next ones.

    points: ``volume_id, slice_index, value``. Rows with a NULL are left out, NaN too; several values of a slice are averaged. Differences are
    divided by the distance of the indices, so that missing slices don't count as jumps. A volume is cut into chunks of so many
    slices, each with the first two slices of the next chunk as a halo, so that a volume of all rows spreads over tasks.
    """
    rows = points.where("volume_id IS NOT NULL AND slice_index IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    rows = rows.groupBy("volume_id", "slice_index").agg(F.avg("value").alias("value"))
    placed = with_position(rows, ["slice_index"], by=["volume_id"])
    own = F.floor(F.col("position") / chunk)
    halo = (F.col("position") % chunk < 2) & (F.col("position") >= chunk)
    spread = placed.withColumn("_chunk", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy("volume_id", "_chunk").orderBy("position")
    s0, s1, s2 = F.col("slice_index"), F.lead("slice_index", 1).over(w), F.lead("slice_index", 2).over(w)
    v0, v1, v2 = F.col("value"), F.lead("value", 1).over(w), F.lead("value", 2).over(w)
    step = (v1 - v0) / (s1 - s0)
    bend = 2 * ((v2 - v1) / (s2 - s1) - step) / (s2 - s0)
    found = spread.withColumns({"step": step, "bend": bend}).where(F.floor(F.col("position") / chunk) == F.col("_chunk"))
    return found.select("volume_id", "slice_index", "value", "step", "bend")


def trajectory_roughness(steps: DataFrame) -> DataFrame:
    """Per volume ``n_slices, mean_step`` (absolute), ``roughness`` (mean squared second difference) and ``sharpest_bend``; NULL with too few slices."""
    return steps.groupBy("volume_id").agg(
        F.count("*").alias("n_slices"), F.avg(F.abs("step")).alias("mean_step"), F.avg(F.col("bend") * F.col("bend")).alias("roughness"), F.max(F.abs("bend")).alias("sharpest_bend")
    )
