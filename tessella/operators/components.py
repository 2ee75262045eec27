"""Connected components of masks over blocks, and how they continue from slice to slice.

A block's foreground is held as runs of pixels along rows.  Runs that touch are joined within the block (union by smallest label, all
runs at once); what a block shares with others are the runs along its four sides.  Sides meet in groups of ``FAN`` x ``FAN``
blocks, then groups meet in groups of groups, each time with only the outer sides left, so that no task holds more than the rim of what
it joins.  A component is named by its first pixel in reading order, whatever the block size.  Pixels touch along edges, not corners.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.blocks import map_blocks, pixels, spread_over_blocks
from tessella.session import pin

FAN = 16
_RUNS = "by int, bx int, img_h int, img_w int, runs binary, nodes binary, sides binary"
TOP, BOTTOM, LEFT, RIGHT = range(4)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` items joined by edges ``a - b``: the smallest item of each one's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def overlapping(start: np.ndarray, stop: np.ndarray, to_start: np.ndarray, to_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of intervals that overlap; the second set is sorted and disjoint."""
    first, last = np.searchsorted(to_stop, start, "right"), np.searchsorted(to_start, stop)
    counts = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(start)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + first[i]


def row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end of each run of foreground, in reading order."""
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(step == 1)
    return y, start, np.nonzero(step == -1)[1]


def _label(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, and for each of them the first run of its component."""
    y, start, stop = row_runs(mask)
    wide = mask.shape[1] + 1
    a, b = overlapping((y + 1) * wide + start, (y + 1) * wide + stop, y * wide + start, y * wide + stop)
    return y, start, stop, connected(len(y), a, b)


def _merged_steps(line: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Rows ``first, end, node`` of neighbouring single steps with the same node; sorted by ``line``."""
    if not len(line):
        return np.zeros((0, 3), np.int64)
    new = np.append(True, (line[1:] != line[:-1] + 1) | (node[1:] != node[:-1]))
    first = np.flatnonzero(new)
    return np.stack([line[first], line[np.append(first[1:], len(line)) - 1] + 1, node[first]], axis=1)


def labelled_blocks(mask_blocks: DataFrame, test: Callable = lambda a: a > 0, dtype=np.uint8) -> DataFrame:
    """One row for each block with foreground, as packed 64-bit integers: ``runs`` (row, first column, end, node), ``nodes`` (node, area, box) of
    its components, and ``sides`` (side, place of the line, first, end, node) along borders with other blocks."""

    def kernel(b):
        y, start, stop, root = _label(np.asarray(test(pixels(b, dtype)), bool))
        if not len(y):
            return None
        y, start, stop = y + b["y0"], start + b["x0"], stop + b["x0"]
        node = (y * b["img_w"] + start)[root]
        names, at = np.unique(node, return_inverse=True)
        area = np.bincount(at, stop - start).astype(np.int64)
        low = [np.full(len(names), 1 << 62) for _ in range(2)]
        high = [np.zeros(len(names), np.int64) for _ in range(2)]
        for box, value in ((low, (y, start)), (high, (y + 1, stop))):
            for side, v in zip(box, value):
                (np.minimum if box is low else np.maximum).at(side, at, v)
        ends = b["y0"] + b["h"], b["x0"] + b["w"]
        sides = []
        for side, line, limit, on in ((TOP, b["y0"], b["img_h"], y == b["y0"]), (BOTTOM, ends[0], b["img_h"], y == ends[0] - 1), (LEFT, b["x0"], b["img_w"], start == b["x0"]), (RIGHT, ends[1], b["img_w"], stop == ends[1])):
            if 0 < line < limit:
                part = np.stack([start, stop, node], axis=1)[on] if side in (TOP, BOTTOM) else _merged_steps(y[on], node[on])
                sides.append(np.column_stack([np.full(len(part), side), np.full(len(part), line), part]))
        packed = [np.stack([y, start, stop, node], axis=1), np.stack([names, area, *low, *high], axis=1), np.concatenate(sides) if sides else np.zeros((0, 5), np.int64)]
        return {"by": [b["by"]], "bx": [b["bx"]], "img_h": [b["img_h"]], "img_w": [b["img_w"]]} | {c: [np.ascontiguousarray(v, np.int64).tobytes()] for c, v in zip(("runs", "nodes", "sides"), packed)}

    return map_blocks(mask_blocks, kernel, _RUNS)


def _table(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, width)


def _join_sides(sides: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sides of blocks of a group: (node, root) of those nodes that get another name, and the sides along the group's own border.

    reach: size of a group; lines at its multiples are borders between groups.
    """
    names, at = np.unique(sides[:, 4], return_inverse=True)
    far, edges = int(sides[:, 3].max()) + 1, []
    for one, other in ((BOTTOM, TOP), (RIGHT, LEFT)):
        a, b = (np.flatnonzero(sides[:, 0] == s) for s in (one, other))
        b = b[np.lexsort((sides[b, 2], sides[b, 1]))]
        start, stop = (sides[:, 1] * far + sides[:, c] for c in (2, 3))
        i, j = overlapping(start[a], stop[a], start[b], stop[b])
        edges.append((at[a[i]], at[b[j]]))
    root = connected(len(names), *(np.concatenate(e) for e in zip(*edges)))
    outer = sides[sides[:, 1] % reach == 0].copy()
    outer[:, 4] = names[root[at[sides[:, 1] % reach == 0]]]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[moved], names[root[moved]]], axis=1), outer


def _joiner(reach: int) -> Callable[[pa.Table], pa.Table]:
    def join(part: pa.Table) -> pa.Table:
        packed = _join_sides(np.concatenate([_table(v.as_buffer(), 5) for v in part["sides"]]), reach)
        own = [part[c].combine_chunks().slice(0, 1) for c in ("image_id", "by", "bx")]
        return pa.table([*own, *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in packed)], names=["image_id", "by", "bx", "names", "sides"])

    return join


def component_names(labelled: DataFrame, block: int) -> list[DataFrame]:
    """For each level of groups ``image_id, node, root``: new names of nodes that met others. A node has at most one row on a level."""
    top = labelled.where(F.length("sides") > 0).agg(F.max(F.greatest("by", "bx"))).first()[0]
    sides = labelled.where(F.length("sides") > 0).select("image_id", "by", "bx", "sides")
    found, reach = [], 1
    while top is not None and reach <= top:
        reach *= FAN
        schema = T.StructType([labelled.schema["image_id"], *T.StructType.fromDDL("by int, bx int, names binary, sides binary").fields])

        group = [F.floor(F.col(c) / FAN).cast("int").alias(c) for c in ("by", "bx")]
        level = pin(sides.select("image_id", *group, "sides").groupBy("image_id", "by", "bx").applyInArrow(_joiner(reach * block), schema))
        found.append(_unpacked(level.select("image_id", F.col("names").alias("packed")), ["node", "root"]))
        sides = level.where(F.length("sides") > 0).select("image_id", "by", "bx", "sides")
    return found


def _unpacked(rows: DataFrame, names: list[str], carry: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A row for each row of the packed tables."""

    def kernel(r):
        got = _table(r["packed"], len(names))
        return {n: got[:, i] for i, n in enumerate(names)} if len(got) else None

    return map_blocks(rows, kernel, ", ".join(f"{n} bigint" for n in names), carry)


def renamed(rows: DataFrame, levels: list[DataFrame], image: str = "image_id", node: str = "node") -> DataFrame:
    """``rows`` with each node replaced by its component."""

    def step(rows: DataFrame, level: DataFrame) -> DataFrame:
        names = level.select(F.col("image_id").alias("_image"), F.col("node").alias("_node"), F.col("root").alias("_root"))
        joined = rows.join(names, (F.col(image) == F.col("_image")) & (F.col(node) == F.col("_node")), "left")
        return joined.withColumn(node, F.coalesce("_root", node)).drop("_image", "_node", "_root")

    return reduce(step, levels, rows)


def components(labelled: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``image_id, component, area, y0, x0, y1, x1``: components with their areas and boxes (half-open)."""
    nodes = _unpacked(labelled.select("image_id", F.col("nodes").alias("packed")), ["node", "area", "y0", "x0", "y1", "x1"])
    found = renamed(nodes, levels).groupBy("image_id", F.col("node").alias("component"))
    return found.agg(F.sum("area").alias("area"), *(F.min(c).alias(c) for c in ("y0", "x0")), *(F.max(c).alias(c) for c in ("y1", "x1")))


def mask_components(mask_blocks: DataFrame, block: int, test: Callable = lambda a: a > 0, dtype=np.uint8) -> DataFrame:
    """Components of each mask; an empty mask has none."""
    labelled = pin(labelled_blocks(mask_blocks, test, dtype))
    return components(labelled, component_names(labelled, block))


def component_overlaps(labelled: DataFrame, levels: list[DataFrame], pairs: DataFrame, block: int) -> DataFrame:
    """``image_id, next_id, component, next_component, overlap``: pixels that components of paired masks have in common.

    pairs: ``image_id, next_id, img_h, img_w`` (of the common frame).  Runs of both masks meet by block; no pixel moves.
    """
    cells = spread_over_blocks(pairs, block).select("image_id", "next_id", "by", "bx")
    one = labelled.select("image_id", "by", "bx", F.col("runs").alias("a"))
    other = labelled.select(F.col("image_id").alias("next_id"), "by", "bx", F.col("runs").alias("b"))
    both = cells.join(one, ["image_id", "by", "bx"]).join(other, ["next_id", "by", "bx"])

    def kernel(r):
        a, b = _table(r["a"], 4), _table(r["b"], 4)
        far = int(max(a[:, 2].max(), b[:, 2].max())) + 1
        i, j = overlapping(a[:, 0] * far + a[:, 1], a[:, 0] * far + a[:, 2], b[:, 0] * far + b[:, 1], b[:, 0] * far + b[:, 2])
        if not len(i):
            return None
        common = np.minimum(a[i, 2], b[j, 2]) - np.maximum(a[i, 1], b[j, 1])
        nodes, at = np.unique(np.stack([a[i, 3], b[j, 3]], axis=1), axis=0, return_inverse=True)
        return {"component": nodes[:, 0], "next_component": nodes[:, 1], "overlap": np.bincount(at.ravel(), common).astype(np.int64)}

    met = map_blocks(both, kernel, "component bigint, next_component bigint, overlap bigint", ("image_id", "next_id"))
    named = renamed(renamed(met, levels, "image_id", "component"), levels, "next_id", "next_component")
    return named.groupBy("image_id", "next_id", "component", "next_component").agg(F.sum("overlap").alias("overlap"))


def continuity(found: DataFrame, overlaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair of slices ``components, next_components, continued`` (of the first's components: have a common pixel with the next slice),
    ``begun`` (of the next one's: have none with the first), ``overlap`` and ``dice``, twice the overlap over both areas (NULL if both are empty)."""
    totals = found.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    own = totals.select("image_id", F.col("n").alias("components"), F.col("area").alias("_a"))
    after = totals.select(F.col("image_id").alias("next_id"), F.col("n").alias("next_components"), F.col("area").alias("_b"))
    # Partners of a component are merged before a pair's are counted, so that a component of very many partners is one row there.
    key = ["image_id", "next_id"]
    going = overlaps.groupBy(*key, "component").agg(F.sum("overlap").alias("overlap")).groupBy(*key).agg(F.count("*").alias("continued"), F.sum("overlap").alias("overlap"))
    coming = overlaps.select(*key, "next_component").distinct().groupBy(*key).agg(F.count("*").alias("_met"))
    rows = pairs.select(*key).join(own, "image_id", "left").join(after, "next_id", "left").join(going, key, "left").join(coming, key, "left")
    rows = rows.fillna(0, ["components", "next_components", "continued", "overlap", "_a", "_b", "_met"])
    both = F.col("_a") + F.col("_b")
    return rows.select(*key, "components", "next_components", "continued", (F.col("next_components") - F.col("_met")).alias("begun"), "overlap", F.when(both > 0, 2 * F.col("overlap") / both).alias("dice"))
