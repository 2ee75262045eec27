"""Pixel counts of overlapping tiles from counts of breakpoint cells.

An axis is cut wherever a tile starts or ends.  Between two cuts the same tiles cover every pixel, so a tile is a sum of whole cells.
A block sends one count per cell and class instead of a share for every tile it meets, packed into one row for each group of
tiles that it touches.  A group is ``GROUP`` x ``GROUP`` tile origins: its cells form a small grid, whose integral image gives all of
the group's tiles, or only those that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.operators.blocks import FLUSH, map_batches, map_blocks, pixels

GROUP = 64  # tile origins of a group along each axis
_CELLS = "gy int, gx int, img_h int, img_w int, cy int, cx int, ny int, nx int, counts binary"


@lru_cache(maxsize=1 << 12)
def axis_cuts(length: int, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile origins along an axis (multiples of the stride and the flush one), and the places where any tile starts or ends."""
    if length < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = length - size
    origins = np.arange(0, last + 1, stride)
    if last % stride:
        origins = np.append(origins, last)
    return origins, np.union1d(origins, origins + size)


def _span(origins: np.ndarray, cuts: np.ndarray, group: int, size: int) -> tuple[np.ndarray, int, int]:
    """Origins of a group, and its first and last cell (half-open)."""
    own = origins[group * GROUP : (group + 1) * GROUP]
    return own, int(np.searchsorted(cuts, own[0])), int(np.searchsorted(cuts, own[-1] + size))


@lru_cache(maxsize=1 << 14)
def _inside(length: int, start: int, n: int, size: int, stride: int):
    """A block along one axis: its first cell, where its cells start within it, and the groups of tiles that it meets."""
    origins, cuts = axis_cuts(length, size, stride)
    first, last = np.searchsorted(origins, start - size, "right"), np.searchsorted(origins, start + n)
    if first >= last:
        return None
    inner = cuts[(cuts > start) & (cuts < start + n)]
    groups = [(g, *_span(origins, cuts, g, size)[1:]) for g in range(first // GROUP, (last - 1) // GROUP + 1)]
    return int(np.searchsorted(cuts, start, "right")) - 1, np.append(0, inner - start), groups


def _counts(kinds: np.ndarray, rows: np.ndarray, cols: np.ndarray, classes: int) -> np.ndarray:
    """Pixels of each class by cell: (rows, columns, classes). Values outside 0 to ``classes - 1`` aren't counted."""
    if kinds.dtype == bool:
        return np.add.reduceat(np.add.reduceat(kinds, rows, axis=0, dtype=np.int32), cols, axis=1, dtype=np.int32)[:, :, None]
    h, w = kinds.shape
    cell = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, h)))[:, None] * len(cols) + np.repeat(np.arange(len(cols)), np.diff(np.append(cols, w)))
    slot = np.where((kinds >= 0) & (kinds < classes), kinds, classes)
    found = np.bincount((cell * (classes + 1) + slot).ravel(), minlength=len(rows) * len(cols) * (classes + 1))
    return found.reshape(len(rows), len(cols), classes + 1)[:, :, :classes].astype(np.int32)


def cell_counts(blocks: DataFrame, size: int, stride: int, kinds, classes: int = 1, dtype=np.uint8, skip_zero: bool = False) -> DataFrame:
    """Counts of the cells of each block, one row for each group of tiles it meets. ``kinds(array)`` gives a class to each pixel, or says of each
    whether it counts."""

    def kernel(b):
        ys = _inside(b["img_h"], b["y0"], b["h"], size, stride)
        xs = _inside(b["img_w"], b["x0"], b["w"], size, stride)
        if ys is None or xs is None:
            return None
        (cy, rows, gys), (cx, cols, gxs) = ys, xs
        counts = _counts(np.asarray(kinds(pixels(b, dtype))), rows, cols, classes)
        out: dict[str, list] = {n.split()[0]: [] for n in _CELLS.split(", ")}
        for gy, ya, yb in gys:
            for gx, xa, xb in gxs:
                ya_, xa_ = max(ya, cy), max(xa, cx)
                part = counts[ya_ - cy : max(yb - cy, 0), xa_ - cx : max(xb - cx, 0)]
                if part.size and not (skip_zero and not part.any()):
                    values = (gy, gx, b["img_h"], b["img_w"], ya_, xa_, part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes())
                    for name, v in zip(out, values):
                        out[name].append(v)
        return out

    return map_blocks(blocks, kernel, _CELLS)


@lru_cache(maxsize=1 << 12)
def _axis(length: int, size: int, stride: int, group: int) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """A group along one axis: its origins, its first cell and number of cells, and where each tile starts and ends among them."""
    origins, cuts = axis_cuts(length, size, stride)
    own, first, last = _span(origins, cuts, group, size)
    return own, first, last - first, np.searchsorted(cuts, own) - first, np.searchsorted(cuts, own + size) - first


class _Grid:
    """The cells of one group of tiles."""

    def __init__(self, gy: int, gx: int, img_h: int, img_w: int, size: int, stride: int, classes: int):
        self.ys, self.y0, ny, self.ya, self.yb = _axis(img_h, size, stride, gy)
        self.xs, self.x0, nx, self.xa, self.xb = _axis(img_w, size, stride, gx)
        self.area = np.zeros((ny + 1, nx + 1, classes), np.int64)
        self.open = True

    def add(self, cy: int, cx: int, ny: int, nx: int, counts: bytes) -> None:
        y, x = cy - self.y0 + 1, cx - self.x0 + 1
        self.area[y : y + ny, x : x + nx] += np.frombuffer(counts, np.int32).reshape(ny, nx, -1)

    def _differences(self, ya, yb, xa, xb) -> np.ndarray:
        if self.open:
            np.cumsum(self.area, axis=0, out=self.area)
            np.cumsum(self.area, axis=1, out=self.area)
            self.open = False
        return self.area[yb, xb] - self.area[ya, xb] - self.area[yb, xa] + self.area[ya, xa]

    def all_tiles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self._differences(self.ya[:, None], self.yb[:, None], self.xa, self.xb)
        return self.ys.repeat(len(self.xs)), np.concatenate([self.xs] * len(self.ys)), n.reshape(-1, n.shape[2])

    def tiles(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, to = np.searchsorted(self.ys, y), np.searchsorted(self.xs, x)
        return self._differences(self.ya[at], self.yb[at], self.xa[to], self.xb[to])


_KEY = ["image_id", "gy", "gx"]


def _tasks(rows: DataFrame) -> int:
    """Packed cells are few bytes for much work: their partitions aren't to be coalesced by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_type(classes: int) -> T.DataType:
    return T.LongType() if classes == 1 else T.ArrayType(T.LongType())


def _count_array(n: np.ndarray, classes: int) -> pa.Array:
    if classes == 1:
        return pa.array(n[:, 0], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * classes, pa.int32()), pa.array(n.ravel(), pa.int64()))


def tile_sums(cells: DataFrame, size: int, stride: int, classes: int = 1, name: str = "n", skip_zero: bool = False) -> DataFrame:
    """``image_id, tile_y, tile_x, <name>`` of every tile: a count, or an array of counts by class.

    Cells stream in the order of their groups, so that a task holds one group's grid however many images or blocks it gets.
    """
    columns = cells.columns
    ordered = cells.repartition(_tasks(cells), *_KEY).sortWithinPartitions(*_KEY)
    schema = T.StructType([cells.schema["image_id"], T.StructField("tile_y", T.IntegerType()), T.StructField("tile_x", T.IntegerType()), T.StructField(name, count_type(classes))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        done: list[tuple] = []
        size_of, key, grid = 0, None, None

        def close() -> int:
            y, x, n = grid.all_tiles()
            if skip_zero:
                some = n.any(axis=1)
                y, x, n = y[some], x[some], n[some]
            done.append((key[0], y, x, n))
            return n.nbytes

        def pack() -> pa.RecordBatch:
            ids = pa.array([d[0] for d in done], arrow.field(0).type).take(pa.array(np.repeat(np.arange(len(done)), [len(d[1]) for d in done])))
            y, x, n = (np.concatenate([d[i] for d in done]) for i in (1, 2, 3))
            return pa.RecordBatch.from_arrays([ids, pa.array(y, pa.int32()), pa.array(x, pa.int32()), _count_array(n, classes)], schema=arrow)

        for batch in batches:
            for at in zip(*(batch.column(c).to_pylist() for c in columns)):
                if at[:3] != key:
                    if grid is not None:
                        size_of += close()
                        if size_of > FLUSH // 8:
                            yield pack()
                            done, size_of = [], 0
                    key, grid = at[:3], _Grid(*at[1:5], size, stride, classes)
                grid.add(*at[5:])
        if grid is not None:
            close()
            yield pack()

    return map_batches(ordered, run, schema)


def origin_group(origin: str, stride: int) -> Column:
    """Group along an axis of the tile with this origin; the flush one comes after the last multiple of the stride below it."""
    return F.floor(F.ceil(F.col(origin) / stride) / GROUP).cast("int")


def asked_sums(cells: DataFrame, tiles: DataFrame, size: int, stride: int, name: str = "n") -> DataFrame:
    """``tiles`` (``image_id, tile_y, tile_x`` and any other columns) with the count of each; 0 where no cell was counted.

    Both sides are dealt by group of tiles; a tile follows the cells of its group, so only asked tiles become rows.
    """
    asked = tiles.select("image_id", origin_group("tile_y", stride).alias("gy"), origin_group("tile_x", stride).alias("gx"), F.struct(*(F.col(f"`{c}`") for c in tiles.columns)).alias("tile"))
    columns = cells.columns
    both = cells.unionByName(asked, allowMissingColumns=True)
    ordered = both.repartition(_tasks(cells), *_KEY).sortWithinPartitions(*_KEY, F.col("tile").isNotNull())
    schema = T.StructType([asked.schema["tile"], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        key, grid = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY)))
            is_tile = batch.column("tile").is_valid().to_numpy(zero_copy_only=False)
            cols = [batch.column(c).to_pylist() for c in columns[3:]]
            found, counts = np.flatnonzero(is_tile), np.zeros(batch.num_rows, np.int64)
            tile = batch.column("tile")
            ys, xs = (tile.field(c).to_numpy(zero_copy_only=False) for c in ("tile_y", "tile_x"))
            row = 0
            while row < len(keys):
                if keys[row] != key:
                    key, grid = keys[row], None
                if not is_tile[row]:
                    at = [c[row] for c in cols]
                    grid = grid or _Grid(key[1], key[2], at[0], at[1], size, stride, 1)
                    grid.add(*at[2:])
                    row += 1
                    continue
                stop = row
                while stop < len(keys) and keys[stop] == key:
                    stop += 1
                if grid is not None:
                    counts[row:stop] = grid.tiles(ys[row:stop].astype(np.int64), xs[row:stop].astype(np.int64))[:, 0]
                row = stop
            if len(found):
                yield pa.RecordBatch.from_arrays([tile.take(pa.array(found)), pa.array(counts[found])], schema=arrow)

    return map_batches(ordered, run, schema).select("tile.*", name)
