"""Raster operators on small hand-made images, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blend, blocks, masks, quality, resample, roi, saliency, tiles

RNG = np.random.default_rng(3)


def images(*shapes, nch=3):
    return {i: RNG.integers(0, 256, (h, w, nch) if nch > 1 else (h, w)).astype(np.uint8) for i, (h, w) in enumerate(shapes)}


SHAPES = [(40, 33), (16, 16), (7, 50), (64, 9)]


def origins(n, size, stride):
    if n < size:
        return []
    return sorted({*range(0, n - size + 1, stride), n - size})


@pytest.mark.parametrize("block", [8, 16, 64])
@pytest.mark.parametrize("size,stride", [(16, 5), (7, 7), (9, 4)])
def test_tile_counts_match_brute_force(make_blocks, block, size, stride):
    src = {k: v * (RNG.random(v.shape) < 0.4) for k, v in images(*SHAPES, nch=1).items()}
    got = {(r.image_id, r.tile_y, r.tile_x): r.n for r in tiles.tile_counts(make_blocks(src, block), size, stride, lambda a: a > 0, "n").collect()}
    want = {(k, y, x): int((a[y : y + size, x : x + size] > 0).sum()) for k, a in src.items() for y in origins(a.shape[0], size, stride) for x in origins(a.shape[1], size, stride)}
    assert got == want
    some = tiles.tile_counts(make_blocks(src, block), size, stride, lambda a: a > 0, "n", skip_zero=True)
    assert {(r.image_id, r.tile_y, r.tile_x): r.n for r in some.collect()} == {k: v for k, v in want.items() if v}


def test_axis_positions(spark):
    df = spark.createDataFrame([(n,) for n in (5, 16, 17, 32, 37)], "n int").select("n", tiles.axis_positions(F.col("n"), 16, 8).alias("p"))
    assert {r.n: r.p for r in df.collect()} == {n: origins(n, 16, 8) for n in (5, 16, 17, 32, 37)}


@pytest.mark.parametrize("mode,limit", [("top_coverage", 2), ("random", 3), ("random", 100), ("random", 0)])
def test_cap_is_exact_and_does_not_depend_on_partitions(spark, mode, limit):
    rows = [(i, y, x, ((y * 7 + x * 3 + i) % 5) / 5) for i in range(3) for y in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "image_id int, tile_y int, tile_x int, tile_mask_coverage double")
    a = {tuple(r) for r in tiles.cap_per_image(df, limit, mode, 5).collect()}
    b = {tuple(r) for r in tiles.cap_per_image(df.repartition(7), limit, mode, 5).collect()}
    assert a == b and len(a) == (3 * min(limit, 12) if limit > 0 else 36)
    if mode == "top_coverage":
        for i in range(3):
            best = sorted([r for r in rows if r[0] == i], key=lambda r: (-r[3], r[1], r[2]))[:limit]
            assert set(best) == {r for r in a if r[0] == i}


def test_cap_plans_a_group_limit_on_the_map_side(spark):
    df = spark.range(1000).selectExpr("id % 3 AS image_id", "id AS tile_y", "0L AS tile_x", "0.5D AS tile_mask_coverage")
    plan = tiles.cap_per_image(df, 5, "random", 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("block", [8, 16])
@pytest.mark.parametrize("rim", [1, 3, 9])
def test_rim(make_blocks, block, rim):
    src = images(*SHAPES)
    for r in blocks.with_rim(make_blocks(src, block), block, rim).collect():
        y0, x0 = max(0, r.by * block - rim), max(0, r.bx * block - rim)
        y1, x1 = min(r.img_h, r.by * block + block + rim), min(r.img_w, r.bx * block + block + rim)
        assert (r.y0, r.x0, r.h, r.w) == (y0, x0, y1 - y0, x1 - x0)
        assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3), src[r.image_id][y0:y1, x0:x1])


@pytest.mark.parametrize("radius", [0, 1, 2.6, 7])
def test_square_dilation(make_blocks, read_blocks, radius):
    src = {k: ((v > 240) * 255).astype(np.uint8) for k, v in images(*SHAPES, nch=1).items()}
    got = read_blocks(masks.dilate(make_blocks(src, 16), 16, radius))
    r = int(round(radius))
    for k, a in src.items():
        p = np.pad(a, r)
        want = np.max([p[y : y + a.shape[0], x : x + a.shape[1]] for y in range(2 * r + 1) for x in range(2 * r + 1)], axis=0)
        assert np.array_equal(got[k], want)


def test_ellipse_dilation(make_blocks, read_blocks):
    src = {0: np.zeros((30, 30), np.uint8)}
    src[0][15, 15] = 255
    offsets = masks.ellipse_offsets(5)
    got = read_blocks(masks.dilate(make_blocks(src, 8), 8, offsets=offsets))[0]
    assert {(y - 15, x - 15) for y, x in zip(*np.nonzero(got))} == set(offsets)
    assert len([o for o in offsets if o[0] == -2]) == 1 and len([o for o in offsets if o[0] == 0]) == 5


@pytest.mark.parametrize("block", [8, 32])
def test_soften(make_blocks, read_blocks, block):
    src = {k: ((v > 128) * 255).astype(np.uint8) for k, v in images(*SHAPES, nch=1).items()}
    got = read_blocks(masks.soften(make_blocks(src, block), block, 1.5))
    w = masks.gauss(1.5)
    r = len(w) // 2
    for k, a in src.items():
        p = np.pad(a.astype(float), r, mode="edge")
        rows = sum(w[d] * p[:, d : d + a.shape[1]] for d in range(2 * r + 1))
        want = np.floor(np.round(sum(w[d] * rows[d : d + a.shape[0]] for d in range(2 * r + 1)), 6) + 0.5)
        assert np.array_equal(got[k], want.astype(np.uint8))


@pytest.mark.parametrize("filt", ["triangle", "lanczos"])
@pytest.mark.parametrize("out", [(16, 16), (11, 70), (90, 5)])
def test_linear_resize_does_not_depend_on_blocks(make_blocks, read_blocks, filt, out):
    src = images(*SHAPES)
    small = read_blocks(resample.resize_linear(make_blocks(src, 8), 8, lambda b: out, filt))
    for k, a in src.items():
        _, wy = resample.axis_weights(a.shape[0], out[0], 0, a.shape[0], filt)
        _, wx = resample.axis_weights(a.shape[1], out[1], 0, a.shape[1], filt)
        assert np.allclose(wy.sum(axis=1), 1) and wy.shape[0] == out[0]
        assert np.array_equal(small[k], resample.to_levels(np.einsum("ij,jkc,lk->ilc", wy, a, wx)))


def test_resize_to_the_same_size_changes_nothing(make_blocks, read_blocks):
    src = images(*SHAPES)
    got = read_blocks(resample.resize_linear(make_blocks(src, 8), 8, lambda b: (b["img_h"], b["img_w"])))
    assert all(np.array_equal(got[k], a) for k, a in src.items())


def test_nearest_resize(make_blocks, read_blocks):
    src = images(*SHAPES, nch=1)
    got = read_blocks(resample.resize_nearest(make_blocks(src, 8), 8, lambda b: (21, 13)))
    for k, a in src.items():
        yy = np.floor((np.arange(21) + 0.5) * a.shape[0] / 21).astype(int)
        xx = np.floor((np.arange(13) + 0.5) * a.shape[1] / 13).astype(int)
        assert np.array_equal(got[k], a[np.ix_(yy, xx)])


def test_letterbox_fills_the_square(make_blocks, read_blocks):
    src = {0: np.full((4, 40, 3), 200, np.uint8), 1: np.full((40, 4, 3), 100, np.uint8)}
    got = read_blocks(resample.letterbox(make_blocks(src, 8), 8, 32))
    assert got[0].shape == (32, 32, 3)
    assert np.array_equal(np.flatnonzero(got[0].any(axis=(1, 2))), np.arange(14, 17))
    assert set(np.unique(got[0])) == {0, 200} and set(np.unique(got[1])) == {0, 100}


def test_palette_and_regions(make_blocks, read_blocks):
    colours = list(roi.PALETTE) + [(9, 9, 9)]
    picks = RNG.integers(0, len(colours), (20, 30))
    ids = np.array([*roi.PALETTE.values(), -1])[picks]
    src = make_blocks({0: np.array(colours, np.uint8)[picks]}, 8)
    assert np.array_equal(read_blocks(roi.decode_palette(src), np.int8)[0], ids)
    classes = roi.decode_palette(src, unknown=0)
    flat = np.maximum(ids, 0)
    assert np.array_equal(read_blocks(roi.roi_blocks(classes, exclude=(2,)))[0] > 0, (flat != 0) & (flat != 2))
    assert np.array_equal(read_blocks(roi.roi_blocks(classes, include=(1, 3)))[0] > 0, np.isin(flat, (1, 3)))
    with pytest.raises(ValueError):
        roi.roi_blocks(classes, include=())


def test_dominant_class_ties_and_empty(spark):
    rows = [(1, 0, 50), (1, 4, 9), (1, 3, 9), (2, 0, 5), (3, -1, 7), (3, 2, 1)]
    got = {r.image_id: (r.classes_present, r.dominant_class_id) for r in roi.image_classes(spark.createDataFrame(rows, "image_id int, cid int, n bigint")).collect()}
    assert got == {1: ([0, 3, 4], 3), 2: ([0], 0), 3: ([2], 2)}


def box_of(mask, ratio):
    ys, xs = np.nonzero(mask)
    h, w = mask.shape
    if not len(ys):
        return 0, 0, h, w
    y0, x0, y1, x1 = ys.min(), xs.min(), ys.max() + 1, xs.max() + 1
    py, px = int((y1 - y0) * ratio), int((x1 - x0) * ratio)
    return max(0, y0 - py), max(0, x0 - px), min(h, y1 + py), min(w, x1 + px)


def test_boxes(make_blocks):
    src = {0: np.zeros((20, 30), np.uint8), 1: np.full((20, 30), 255, np.uint8), 2: np.zeros((40, 30), np.uint8), 3: np.zeros((10, 60), np.uint8)}
    src[2][5:30, 20:24] = 1
    src[3][2:4, 10:50] = 1
    got = {r.image_id: tuple(r.box) for r in roi.mask_boxes(make_blocks(src, 8), 0.15).collect()}
    assert got == {k: box_of(a, 0.15) for k, a in src.items()}
    square = {r.image_id: tuple(r.box) for r in roi.mask_boxes(make_blocks(src, 8), 0.15, square=True).collect()}
    y0, x0, y1, x1 = square[2]
    assert (y1 - y0, x1 - x0) == (31, 30) and x1 == 30  # 31 columns are wanted, the frame has 30
    assert square[3][2] - square[3][0] == 10  # the frame is too low for a square
    cover = {r.image_id: r.coverage for r in roi.roi_coverage(make_blocks(src, 8)).collect()}
    assert cover[0] == 0 and cover[1] == 1 and cover[2] == pytest.approx(100 / 1200)


def test_crops(spark, make_blocks):
    src = images((50, 70), (33, 20))
    wanted = [(0, 0, 0), (0, 30, 41), (1, 13, 0), (0, 30, 41 - 9)]
    t = spark.createDataFrame([(i, y, x, x, y, x + 20, y + 20) for i, y, x in wanted], "image_id int, tile_y int, tile_x int, x0 int, y0 int, x1 int, y1 int")
    got = blocks.crop_tiles(t, make_blocks(src, 8), 8).collect()
    assert len(got) == len(wanted)
    for r in got:
        want = src[r.image_id][r.tile_y : r.tile_y + 20, r.tile_x : r.tile_x + 20]
        assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(20, 20, 3), want)


def frame_boxes(spark, src, boxes):
    rows = [(k, a.shape[1], a.shape[0], *boxes[k]) for k, a in src.items()]
    return spark.createDataFrame(rows, "image_id int, img_w int, img_h int, y0b int, x0b int, y1b int, x1b int")


def test_profile_equals_blurred_box():
    n, lo, hi, r = 60, 12, 40, 6
    w = masks.gauss(r / 2)
    half = len(w) // 2
    box = np.zeros(n)
    box[lo:hi] = 1
    p = np.pad(box, half, mode="symmetric")
    want = sum(w[d] * p[d : d + n] for d in range(2 * half + 1))
    want[: lo - r] = want[hi + r :] = 0
    assert np.allclose(blend.axis_profile(n, lo, hi, r), want)
    assert np.allclose(blend.axis_profile(n, lo, hi, r, 10, 30), want[10:30])


def test_paste_back(spark, make_blocks, read_blocks):
    src, new = images((40, 50), (20, 20)), images((40, 50), (20, 20))
    boxes = {0: (6, 9, 30, 41), 1: (0, 0, 20, 20)}
    got = read_blocks(blend.paste_back(make_blocks(src, 16), make_blocks(new, 16), frame_boxes(spark, src, boxes), 16, 4))
    for k, a in src.items():
        y0, x0, y1, x1 = boxes[k]
        t = (blend.axis_profile(a.shape[0], y0, y1, 4)[:, None] * blend.axis_profile(a.shape[1], x0, x1, 4))[:, :, None]
        want = a.copy()
        want[y0:y1, x0:x1] = np.floor(np.round(a * (1 - t) + new[k] * t, 6))[y0:y1, x0:x1]
        assert np.array_equal(got[k], want)
    hard = read_blocks(blend.paste_back(make_blocks(src, 16), make_blocks(new, 16), frame_boxes(spark, src, boxes), 16, 0))
    assert np.array_equal(hard[0][6:30, 9:41], new[0][6:30, 9:41])


def test_placed_patch_fills_its_box(spark, make_blocks, read_blocks):
    frame = {0: np.zeros((40, 50, 3), np.uint8)}
    patch = {0: np.full((16, 16, 3), 77, np.uint8)}
    got = read_blocks(blend.place_patches(make_blocks(patch, 8), frame_boxes(spark, frame, {0: (6, 9, 30, 41)}), 16))[0]
    assert (got[6:30, 9:41] == 77).all() and got.sum() == 77 * 3 * 24 * 32


def numpy_metrics(a, b, box):
    y0, x0, y1, x1 = box
    diff = np.abs(a.astype(float) - b)
    outside = np.ones(a.shape[:2], bool)
    outside[y0:y1, x0:x1] = False
    seam = [diff[y, x0].mean() for y in range(max(0, y0 - 8), min(a.shape[0], y0 + 8))]
    seam += [diff[y, x1 - 1].mean() for y in range(max(0, y1 - 8), min(a.shape[0], y1 + 8))]
    corr = []
    for c in range(3):
        ha, hb = (np.histogram(v[outside][:, c], 64, (0, 255))[0] for v in (a, b))
        corr.append(np.corrcoef(ha, hb)[0, 1])
    return (diff[y0:y1, x0:x1].mean(axis=2) > 10).mean(), diff[outside].mean(), np.mean(seam), np.mean(corr)


def test_quality_metrics(spark, make_blocks):
    src = images((40, 50), (64, 30), (20, 20))
    new = {k: np.clip(a.astype(int) + RNG.integers(-20, 20, a.shape), 0, 255).astype(np.uint8) for k, a in src.items()}
    boxes = {0: (6, 9, 30, 41), 1: (0, 0, 10, 30), 2: (0, 0, 20, 20)}
    counters = quality.edit_counters(make_blocks(src, 16), make_blocks(new, 16), frame_boxes(spark, src, boxes), 16)
    got = {r.image_id: r for r in quality.judge(quality.edit_metrics(counters)).collect()}
    for k in (0, 1):
        r = got[k]
        assert (r.mask_coverage, r.non_roi_drift, r.seam_quality, r.histogram_similarity) == pytest.approx(numpy_metrics(src[k], new[k], boxes[k]))
    assert got[2].non_roi_drift is None and got[2].histogram_similarity == 1.0
    assert not any("drift" in x for x in got[2].rejection_reasons)


def test_flat_histogram_is_not_measurable(spark, make_blocks):
    flat = {0: np.tile(np.arange(64, dtype=np.uint8)[:, None, None] * 4, (1, 20, 3))}
    counters = quality.edit_counters(make_blocks(flat, 16), make_blocks(flat, 16), frame_boxes(spark, flat, {0: (0, 0, 1, 0)}), 16)
    row = quality.judge(quality.edit_metrics(counters), quality.Limits(min_coverage=-1)).collect()[0]
    assert row.histogram_similarity is None and row.passed


def test_brush_masks(make_blocks):
    white = {0: np.full((48, 60, 3), 255, np.uint8), 1: np.zeros((48, 60, 3), np.uint8)}
    p = masks.Brush(attempts=20, min_px=4, max_px=12, max_strokes=3)
    got = {r.image_id: r for r in masks.random_masks(masks.tissue(make_blocks(white, 64)), p).collect()}
    assert got[0].fallback and got[0].attempt == -1 and got[0].n_on == masks.centre_ellipse(60, 48).sum()
    assert not got[1].fallback and p.min_area <= got[1].n_on / (48 * 60) <= p.max_area
    again = {r.image_id: r.data for r in masks.random_masks(masks.tissue(make_blocks(white, 64)).repartition(5), p).collect()}
    assert again[1] == got[1].data
    for r, line in masks.brush_strokes(p, "1", 0, 60, 48):
        assert 1 <= r <= 6 and all(0 <= x < 60 and 0 <= y < 48 for x, y in line)


def test_exact_quantiles(spark):
    rows = [(k, float(v)) for k in range(4) for v in np.round(RNG.random(137 + 40 * k) ** (k + 1), 6)]
    rows += [(5, 0.0)] * 500 + [(5, 1.0)] * 3 + [(6, 0.25)]
    df = spark.createDataFrame(rows, "image_id int, v double").groupBy("image_id", "v").count().withColumnRenamed("count", "n")
    got = {(r.image_id, r.prob): r.q for r in saliency.exact_quantiles(df, "image_id", [0.0, 0.5, 0.85, 0.95, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        vals = [v for i, v in rows if i == k]
        for p in (0.0, 0.5, 0.85, 0.95, 1.0):
            assert got[(k, p)] == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_mask_thresholds_fall_back(spark, make_blocks):
    counts = spark.createDataFrame([(0, i / 100, 1) for i in range(100)] + [(1, 0.0, 90), (1, 0.5, 10)] + [(2, 0.3, 100)], "image_id int, v double, n bigint")
    cut = {r.image_id: r.cut for r in saliency.mask_thresholds(counts, 0.85, 0.05, 0.5).collect()}
    assert cut[0] == pytest.approx(0.8415) and cut[1] == 0.5 and cut[2] == 0.3
    low = {r.image_id: r.cut for r in saliency.mask_thresholds(counts, 0.85, 0.2, 0.5).collect()}
    assert low[0] == pytest.approx(0.7425)


def test_image_scan_puts_channels_in_order(spark, tmp_path):
    from tessella.checks.png import encode_png
    from tessella.sources.images import image_sizes, scan_images
    from tessella.sources.listings import list_folder

    src = images((9, 13))
    (tmp_path / "one.png").write_bytes(encode_png(src[0]))
    (tmp_path / "note.txt").write_text("no image")
    df = scan_images(spark, str(tmp_path), block=8, glob="*.png")
    assert df.count() == 4
    for r in df.collect():
        assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3), src[0][r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w])
    assert [tuple(r) for r in image_sizes(df).collect()] == [("one.png", 13, 9)]
    assert scan_images(spark, str(tmp_path), "grey", 8, "*.png", "stem").select("image_id", "nch").distinct().collect() == [("one", 1)]
    assert {r.filename for r in list_folder(spark, str(tmp_path)).collect()} == {"one.png", "note.txt"}


@pytest.mark.parametrize("limits", [(0.05, 0.5), (0.2, 0.5), (0.05, 0.1)])
def test_heat_cuts_equal_quantiles(spark, make_blocks, limits):
    rng = np.random.default_rng(5)
    arrays = {0: rng.random((23, 17)), 1: np.round(rng.random((20, 20)), 1), 2: np.full((9, 11), 0.25), 3: np.where(rng.random((30, 12)) < 0.9, 0.0, rng.random((30, 12))), 4: np.ones((1, 1))}
    heat = make_blocks(arrays, 8)
    images = spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in arrays.items()], "image_id int, w int, h int")
    got = {r.image_id: r.cut for r in saliency.heat_cuts(heat, images, 8, 0.85, *limits).collect()}
    for k, a in arrays.items():
        q, low, high = (float(np.quantile(a, p)) for p in (0.85, 0.75, 0.95))
        area = (a >= q).mean()
        cut = q
        if area < limits[0]:
            cut, area = low, (a >= low).mean()
        if area > limits[1]:
            cut = high
        assert got[k] == pytest.approx(cut, abs=1e-12), k


def test_many_folders_are_scanned_a_few_at_a_time(spark, make_blocks, read_blocks, tmp_path, monkeypatch):
    from tessella.checks.png import write_pngs
    from tessella.sources import images as source

    arrays = {k: RNG.integers(0, 255, (5 + k, 7, 3), dtype=np.uint8) for k in range(7)}
    folders = write_pngs(make_blocks(arrays, 64), str(tmp_path / "png"), per_folder=2)
    assert [f.rsplit("/", 1)[1] for f in folders] == ["0", "1", "2", "3"]
    (tmp_path / "png" / "3" / "note.txt").write_text("no image")
    asked, load, cost = [], source._load, spark.conf.get(source.OPEN_COST)
    monkeypatch.setattr(source, "_load", lambda spark, path, glob: asked.append(path) or load(spark, path, glob))
    got = read_blocks(source.scan_images(spark, folders, block=4, skip_unreadable=True, at_once=3))
    assert [len(a) for a in asked] == [3, 1] and spark.conf.get(source.OPEN_COST) == cost
    assert all(np.array_equal(got[f"{k}.png"], a) for k, a in arrays.items()) and len(got) == 7
    assert [r.filename for r in source.unreadable_images(spark, folders, at_once=1).collect()] == ["note.txt"]
    with pytest.raises(ValueError):
        source.scan_images(spark, [])


def test_kernels_hold_few_rows_at_once(spark):
    """However full an Arrow batch is, only a slice of it is Python objects at once."""
    from tessella.operators import blocks

    rows = spark.range(0, 3000, 1, 1).withColumnRenamed("id", "image_id")
    sizes = blocks.map_blocks(rows, lambda b: {"n": np.array([1])}, "n bigint", merge=lambda held: [(held[0][0], {"n": np.array([len(held)])})])
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 3000 and max(got) <= blocks.ROWS
    wide = spark.range(0, 60, 1, 1).selectExpr("id AS image_id", "cast(repeat('x', 500000) AS binary) AS data")
    held = blocks.map_blocks(wide, lambda b: {"n": np.array([len(b["data"])])}, "n bigint", merge=lambda held: [(held[0][0], {"n": np.array([sum(int(r["n"][0]) for _, r in held)])})])
    assert max(r.n for r in held.collect()) <= 2 * blocks.HELD


def png_file(arr, kinds, extra=(), colour=None, interlace=0, depth=8):
    """A PNG with the given filter of each row, written from the definition of the filters."""
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, nch = arr.shape
    wide = np.zeros((h + 1, w + 1, nch), int)
    wide[1:, 1:] = arr
    raw = b""
    for y in range(h):
        left, up, corner = wide[y + 1, :-1], wide[y, 1:], wide[y, :-1]
        near = left + up - corner
        by = [abs(near - v) for v in (left, up, corner)]
        paeth = np.where((by[0] <= by[1]) & (by[0] <= by[2]), left, np.where(by[1] <= by[2], up, corner))
        guess = (0, left, up, (left + up) // 2, paeth)[kinds[y]]
        raw += bytes([kinds[y]]) + ((wide[y + 1, 1:] - guess) % 256).astype(np.uint8).tobytes()
    packed = zlib.compress(raw)
    colour = {1: 0, 3: 2, 4: 6}[nch] if colour is None else colour
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)), *extra, (b"IDAT", packed[:9]), (b"IDAT", packed[9:]), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunk(*c) for c in chunks)


def test_plain_pngs_decode_as_the_image_source_does(spark, tmp_path, read_blocks):
    from tessella.sources.images import scan_images
    from tessella.sources.png import decode_png

    src, files = {}, {}
    for nch in (1, 3, 4):
        for name, kinds in {**{str(k): [k] * 9 for k in range(5)}, "all": [4, 3, 2, 1, 0, 1, 4, 2, 3]}.items():
            arr = RNG.integers(0, 256, (9, 11, nch)).astype(np.uint8)
            src[f"{nch}-{name}.png"], files[f"{nch}-{name}.png"] = arr, png_file(arr, kinds)
    arr = src["extra.png"] = RNG.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    files["extra.png"] = png_file(arr, [1] * 9, [(b"gAMA", b"\0\0\xb1\x8f"), (b"sRGB", b"\0"), (b"tEXt", b"a\0b"), (b"pHYs", b"\0" * 9)])
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        assert np.array_equal(decode_png(data), src[name]), name
    got = read_blocks(scan_images(spark, str(tmp_path), block=4))
    for name, arr in src.items():
        assert np.array_equal(got[name], np.repeat(arr, 3, axis=2) if arr.shape[2] == 1 else arr[:, :, :3]), name


def test_png_decoder_leaves_what_is_not_plain():
    from tessella.sources.png import SERIAL, decode_png

    arr = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    whole = png_file(arr, [0] * 6)
    flipped = bytearray(whole)
    flipped[50] ^= 1
    for data in (b"", b"no image", whole[:-1], whole[:-12], whole + b"x", bytes(flipped), png_file(arr, [0] * 6, [(b"tRNS", b"\0" * 6)]), png_file(arr, [0] * 6, [(b"iCCP", b"a\0\0x")]),
                 png_file(arr, [0] * 6, colour=3), png_file(arr, [0] * 6, depth=16), png_file(arr, [0] * 6, interlace=1), png_file(arr[:, :4], [0] * 6)[:-30], png_file(arr[:0], [])):
        assert decode_png(data) is None
    assert np.array_equal(decode_png(whole), arr)
    wide = RNG.integers(0, 256, (2, SERIAL // 3, 3)).astype(np.uint8)
    assert np.array_equal(decode_png(png_file(wide, [1, 4])), wide) and decode_png(png_file(wide, [3, 4])) is None


@pytest.mark.parametrize("mode", ["rgb", "grey"])
def test_folders_of_mixed_files_equal_single_folders(spark, tmp_path, read_blocks, monkeypatch, mode):
    """Plain small PNGs are decoded by Python workers, what they leave and large files by the image source, each once."""
    from tessella.sources import images as source

    imageio, jvm = spark._jvm.javax.imageio.ImageIO, spark._jvm.java
    plain = {n: png_file(RNG.integers(0, 256, (9, 7, 3)).astype(np.uint8), [2] * 9) for n in ("a b+c%20[1].png", "é'\".png", "x.jpg", "{y}*.png")}
    large = png_file(RNG.integers(0, 256, (40, 30, 3)).astype(np.uint8), [0] * 40)
    folders = [tmp_path / n for n in ("one", "two", "three + %2B", "four")]
    for i, f in enumerate(folders):
        f.mkdir()
        for n, data in plain.items():
            if i != 1:
                (f / f"{i}{n}").write_bytes(data)
    for name, kind in (("j.jpg", "jpg"), ("j'+ é.png", "jpg"), ("b.bmp", "bmp")):
        made = jvm.awt.image.BufferedImage(6, 5, 1)
        made.setRGB(2, 3, 0x123456)
        assert imageio.write(made, kind, jvm.io.File(str(folders[2] / name)))
    (folders[0] / "large.png").write_bytes(large)
    (folders[1] / "trns.png").write_bytes(png_file(RNG.integers(0, 256, (5, 5, 3)).astype(np.uint8), [0] * 5, [(b"tRNS", b"\0" * 6)]))
    broken = {"note '+%20.txt": folders[2], "half.png": folders[1]}
    for n, f in broken.items():
        (f / n).write_text("no image")
    monkeypatch.setattr(source, "SMALL", 1000)
    asked, decode = [], source._decode
    monkeypatch.setattr(source, "_decode", lambda spark, path, glob, only=None: asked.append(path) or decode(spark, path, glob, only))
    paths = [str(f) for f in folders]
    blocks, rejects = source.scan_and_report(spark, paths, mode, 8, at_once=1)
    assert [[p.rsplit("/", 1)[1] for p in a] for a in asked] == [["one"], ["two"], ["three + %2B"]]
    got = read_blocks(blocks)
    want = {}
    for p in paths:
        want |= read_blocks(source.scan_images(spark, p, mode, 8, skip_unreadable=True))
    assert got.keys() == want.keys() and len(got) == 3 * len(plain) + 5
    assert all(np.array_equal(got[n], a) for n, a in want.items())
    assert blocks.count() == blocks.select("image_id", "by", "bx").distinct().count()
    assert {(r.filename, r.path.rsplit("/", 2)[1]) for r in rejects.collect()} == {(n, f.name) for n, f in broken.items()}
    assert sorted(r.filename for r in source.unreadable_images(spark, paths).collect()) == sorted(broken)
    with pytest.raises(Exception, match="unreadable image"):
        source.scan_images(spark, paths, mode, 8)


def test_small_pngs_of_folders_do_not_pass_the_image_source(spark, tmp_path, monkeypatch):
    """A serializer is made for every file there, which takes longer than all else."""
    from tessella import checks
    from tessella.sources import images as source

    asked, decode = [], source._decode
    monkeypatch.setattr(source, "_decode", lambda spark, path, glob, only=None: asked.append(only) or decode(spark, path, glob, only))
    queries = checks.load()[0]
    assert queries["image_scan"](spark, "/root/testdata/sf0.001").count() == 200 and not asked
    assert [tuple(r) for r in queries["image_rejects"](spark, "/root/testdata/sf0.001").collect()] == [(200, 1)]
    assert len(asked) == 1  # for the broken file


def test_scan_of_folders_runs_a_kernel_where_blocks_are_decoded(spark, tmp_path):
    from tessella.sources.images import scan_images

    folders = [tmp_path / "a", tmp_path / "b"]
    for i, f in enumerate(folders):
        f.mkdir()
        for k in range(3):
            extra = [(b"iCCP", b"x\0\0")] if k == 2 else []  # left to the image source
            (f / f"{i}{k}.png").write_bytes(png_file(RNG.integers(0, 256, (9 + k, 70, 3)).astype(np.uint8), [k] * (9 + k), extra))
    paths = [str(f) for f in folders]
    more = {"most": lambda a: int(a.max())}
    kernel, fields = blocks.digest_shares(more=more)
    want = sorted(blocks.digest(scan_images(spark, paths, block=32), more=more).collect())
    assert len(want) == 6 and want[0].n_values == 9 * 70 * 3
    assert sorted(blocks.digest_sums(scan_images(spark, paths, block=32, kernel=kernel, fields=fields)).collect()) == want
    one = blocks.digest_sums(scan_images(spark, paths[0], block=32, kernel=kernel, fields=fields))
    assert sorted(one.collect()) == want[:3]
    written = scan_images(spark, paths, block=32, kernel=kernel, fields=fields)
    assert written.columns == ["image_id", "n_values", "sum_v", "pos_sum", "most"] and written.count() == 18
