"""Tiles from breakpoint cells, components over blocks, and coherence along slices, against plain numpy."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cells, coherence, components, tiles

RNG = np.random.default_rng(8)
BOX = "image_id int, y0b int, x0b int, y1b int, x1b int"


def origins(n, size, stride):
    return [] if n < size else sorted({*range(0, n - size + 1, stride), n - size})


@pytest.mark.parametrize("block", [16, 50])
def test_cells_of_many_groups_and_classes(make_blocks, block):
    src = {0: RNG.integers(-1, 4, (100, 83)).astype(np.int8), 1: RNG.integers(-1, 4, (9, 9)).astype(np.int8), 2: np.zeros((8, 90), np.int8)}
    got = {(r.image_id, r.tile_y, r.tile_x): r.counts for r in tiles.tile_classes(make_blocks(src, block), 9, 1, 4).collect()}
    want = {(k, y, x): np.bincount(a[y : y + 9, x : x + 9][a[y : y + 9, x : x + 9] >= 0], minlength=4).tolist() for k, a in src.items() for y in origins(a.shape[0], 9, 1) for x in origins(a.shape[1], 9, 1)}
    assert got == want and len(origins(100, 9, 1)) > cells.GROUP


@pytest.mark.parametrize("block", [8, 32])
def test_only_asked_tiles_become_rows(spark, make_blocks, block):
    src = {k: (RNG.random((h, w, 1)) < 0.3) * np.full((h, w, 3), 255, np.uint8) for k, (h, w) in enumerate([(60, 90), (40, 40), (30, 30)])}
    src[2][:] = 0  # no white at all
    grid = [(k, y, x) for k, a in src.items() for y in origins(a.shape[0], 16, 7) for x in origins(a.shape[1], 16, 7)]
    some = [g for i, g in enumerate(grid) if i % 5 == 0]
    asked = spark.createDataFrame([(*g, "x", 3) for g in some] + [(9, 0, 0, "no image", 4)], "image_id int, tile_y int, tile_x int, `meta.url` string, gy int")
    found = tiles.white_content(make_blocks(src, block), asked, 16, 7, 235).collect()
    assert len(found) == len(some) + 1 and {r["meta.url"] for r in found} == {"x", "no image"}
    want = {(k, y, x): int((src[k][y : y + 16, x : x + 16] >= 235).all(axis=2).sum()) for k, y, x in some} | {(9, 0, 0): 0}
    assert {(r.image_id, r.tile_y, r.tile_x): r.n_white for r in found} == want
    assert tiles.white_content(make_blocks(src, block), asked.limit(0), 16, 7, 235).count() == 0


def test_white_rows_grow_with_tiles_asked_and_cells_with_blocks(make_blocks, spark):
    src = {0: np.full((128, 128, 3), 255, np.uint8)}
    blocks = make_blocks(src, 32)
    sent = cells.cell_counts(blocks, 32, 4, lambda a: a[:, :, 0] > 0)
    assert sent.count() == 16  # a row for each block, though the grid has 625 tiles
    for n in (1, 20):
        asked = spark.createDataFrame([(0, 4 * i, 8) for i in range(n)], "image_id int, tile_y int, tile_x int")
        assert tiles.white_content(blocks, asked, 32, 4, 235).count() == n


def test_majority_needs_more_than_the_threshold(spark):
    rows = [([60, 40, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],), ([61, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1],), ([50, 50] + [0] * 10,), ([0] * 12,), ([0, 0, 99] + [0] * 9,)]
    df = spark.createDataFrame(rows, "counts array<long>")
    got = [(r.majority, r.majority_share, r.coarse_label) for r in tiles.majority_label(df, 10).collect()]
    assert got == [(None, 0.6, "non_cancer"), (0, 0.61, "cancer"), (None, 0.5, "non_cancer"), (None, 0.0, "non_cancer"), (2, 0.99, "non_cancer")]
    assert [r.majority for r in tiles.majority_label(df, 10, 0.4).collect()] == [0, 0, 0, None, 2]


def flood(mask):
    """Components by first pixel: {first: pixels}."""
    seen, out = np.zeros(mask.shape, bool), {}
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        queue, own = deque([(y, x)]), []
        seen[y, x] = True
        while queue:
            a, b = queue.popleft()
            own.append((int(a), int(b)))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    queue.append((c, d))
        out[int(y) * mask.shape[1] + int(x)] = own
    return out


def masks_of():
    spiral = np.zeros((61, 80), np.uint8)
    y, x, dy, dx = 0, 0, 0, 1
    for turn in range(16):
        for _ in range(80 - 4 * turn if dx else 61 - 4 * (turn // 2)):
            if 0 <= y < 61 and 0 <= x < 80:
                spiral[y, x] = 1
            y, x = y + dy, x + dx
        y, x, dy, dx = y - dy, x - dx, dx, -dy
    return {0: spiral, 1: (RNG.random((70, 90)) < 0.6).astype(np.uint8), 2: np.ones((33, 90), np.uint8), 3: np.zeros((20, 20), np.uint8), 4: np.indices((40, 40)).sum(0).astype(np.uint8) % 2, 5: (RNG.random((64, 75)) < 0.59).astype(np.uint8)}


@pytest.mark.parametrize("block", [4, 16, 64])
def test_components_are_those_of_a_flood_fill(make_blocks, block):
    src = masks_of()
    got = {(r.image_id, r.component): (r.area, r.y0, r.x0, r.y1, r.x1) for r in components.mask_components(make_blocks(src, block), block).collect()}
    want = {}
    for k, a in src.items():
        for first, own in flood(a).items():
            ys, xs = zip(*own)
            want[k, first] = len(own), min(ys), min(xs), max(ys) + 1, max(xs) + 1
    assert got == want
    assert 90 // 4 > components.FAN  # the small blocks need a second level


@pytest.mark.parametrize("block", [4, 32])
def test_continuity(spark, make_blocks, block):
    src = masks_of()
    slices = spark.createDataFrame([(k, "v" if k < 5 else None, 10 * k, *a.shape) for k, a in src.items()], "image_id int, volume_id string, slice_index int, img_h int, img_w int")
    pairs = coherence.slice_pairs(slices)
    labelled = components.labelled_blocks(make_blocks(src, block))
    levels = components.component_names(labelled, block)
    overlaps = components.component_overlaps(labelled, levels, pairs, block)
    got = {(r.image_id, r.component, r.next_component): r.overlap for r in overlaps.collect()}
    want, full = {}, {k: {p: c for c, own in flood(a).items() for p in own} for k, a in src.items()}
    for k in range(4):
        for p, c in full[k].items():
            if p in full[k + 1]:
                want[k, c, full[k + 1][p]] = want.get((k, c, full[k + 1][p]), 0) + 1
    assert got == want
    rows = {r.image_id: r for r in components.continuity(components.components(labelled, levels), overlaps, pairs).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    for k, r in rows.items():
        n, m = (len(set(full[i].values())) for i in (k, k + 1))
        area, common = len(full[k]) + len(full[k + 1]), sum(v for (i, *_), v in want.items() if i == k)
        assert (r.components, r.next_components, r.overlap) == (n, m, common)
        assert r.continued == len({c for i, c, _ in want if i == k}) and r.begun == m - len({d for i, _, d in want if i == k})
        assert r.dice == pytest.approx(2 * common / area)


def test_pairs_follow_index_and_name(spark):
    rows = [(1, "a", 5), (2, "a", 3), (3, "a", 5), (4, "b", 1), (5, None, 1), (6, "a", None), (7, "a", 9), (8, None, 1)]
    slices = spark.createDataFrame([(*r, 10 + r[0], 20 - r[0]) for r in rows], "image_id int, volume_id string, slice_index int, img_h int, img_w int")
    got = sorted((r.image_id, r.next_id, r.img_h, r.img_w) for r in coherence.slice_pairs(slices).collect())
    assert got == [(1, 3, 11, 17), (2, 1, 11, 18), (3, 7, 13, 13)]
    assert coherence.slice_pairs(slices.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 7])
def test_similarity_is_that_of_all_free_windows(spark, make_blocks, size):
    src = {k: RNG.integers(0, 256, (h, w, 3)).astype(np.uint8) for k, (h, w) in enumerate([(40, 33), (40, 33), (37, 50), (5, 33), (40, 20)])}
    src[1] = np.minimum(255, src[0].astype(int) + RNG.integers(0, 20, src[0].shape)).astype(np.uint8)
    boxes = {0: (5, 5, 20, 18), 2: (-3, 40, 60, 99), 4: (0, 0, 40, 20)}
    slices = spark.createDataFrame([(k, 0, k, *a.shape[:2]) for k, a in src.items()], "image_id int, volume_id int, slice_index int, img_h int, img_w int")
    edits = spark.createDataFrame([(k, *b) for k, b in boxes.items()], BOX)
    found = [{(r.image_id, r.next_id): (r.n_windows, r.similarity) for r in coherence.slice_similarity(make_blocks(src, block), slices, edits, block, size).collect()} for block in (8, 30)]
    assert found[0] == found[1]  # bit by bit
    for k in range(4):
        grey = [(src[i].astype(int) @ np.array([299, 587, 114]) + 500) // 1000 for i in (k, k + 1)]
        h, w = min(g.shape[0] for g in grey), min(g.shape[1] for g in grey)
        edited = np.zeros((h, w), bool)
        for i in (k, k + 1):
            if i in boxes:
                y0, x0, y1, x1 = boxes[i]
                edited[max(0, y0) : y1, max(0, x0) : x1] = True
        values = []
        for y in range(h - size + 1):
            for x in range(w - size + 1):
                win = slice(y, y + size), slice(x, x + size)
                if not edited[win].any():
                    a, b = (g[win].astype(float) for g in grey)
                    cov = ((a - a.mean()) * (b - b.mean())).mean()
                    values.append((2 * a.mean() * b.mean() + 6.5025) * (2 * cov + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (a.var() + b.var() + 58.5225)))
        n, s = found[0][k, k + 1]
        assert n == len(values) and (s is None if not values else s == pytest.approx(np.mean(values), abs=1e-8))
    assert found[0][0, 1][1] > found[0][1, 2][1]


@pytest.mark.parametrize("chunk", [2, 3, 5, 4096])
def test_steps_do_not_depend_on_chunks(spark, chunk):
    r = np.random.default_rng(2)
    rows = [("long", int(s), float(v)) for s, v in zip(r.choice(500, 90), r.random(90))] + [("two", 4, 0.5), ("two", 9, 1.0), ("one", 1, 0.1), ("tie", 3, 0.0), ("tie", 3, 1.0), ("tie", 4, 0.5)]
    rows += [(None, 1, 0.5), ("long", None, 0.5), ("long", 900, None), ("long", 901, float("nan"))]
    df = spark.createDataFrame(rows, "volume_id string, slice_index int, value double").repartition(3)
    steps = coherence.slice_steps(df, chunk)
    got = {(x.volume_id, x.slice_index): (x.step, x.bend) for x in steps.collect()}
    want, series = {}, {}
    for v, s, x in rows:
        if None not in (v, s, x) and not math.isnan(x):
            series.setdefault(v, {}).setdefault(s, []).append(x)
    for v, at in series.items():
        s = sorted(at)
        x = [np.mean(at[i]) for i in s]
        for i in range(len(s)):
            step = (x[i + 1] - x[i]) / (s[i + 1] - s[i]) if i + 1 < len(s) else None
            bend = 2 * ((x[i + 2] - x[i + 1]) / (s[i + 2] - s[i + 1]) - step) / (s[i + 2] - s[i]) if i + 2 < len(s) else None
            want[v, s[i]] = step, bend
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == tuple(None if x is None else pytest.approx(x) for x in values), key
    rough = {x.volume_id: x for x in coherence.trajectory_roughness(steps).collect()}
    assert (rough["two"].n_slices, rough["two"].mean_step, rough["two"].roughness) == (2, pytest.approx(0.1), None) and rough["one"].mean_step is None
    assert rough["tie"].mean_step == 0 and rough["long"].sharpest_bend == pytest.approx(max(abs(b) for (v, _), (_, b) in want.items() if v == "long" and b is not None))


def test_one_volume_of_all_rows_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("v").alias("volume_id"), F.col("id").alias("slice_index"), F.sin("id").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        steps = coherence.slice_steps(df, 500)
        assert steps.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert steps.where("bend IS NOT NULL").count() == 19_998
