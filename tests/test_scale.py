"""What keeps jobs bounded: pruned ingest, aligned block tables, folds in chunks, models made once per worker."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import coerce
from tessella.operators import blocks, curriculum, joins, masks, quality, resample, roi, sampling, seams
from tessella.plans import patches
from tessella.sources import sinks

RNG = np.random.default_rng(6)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = spark.range(500).select("id", F.lit("old").alias("v")).unionByName(spark.createDataFrame([(None, "old")], "id long, v string"))
    sinks.append_new(first, path, ["id"], buckets=32)
    batch = spark.createDataFrame([(3, "new"), (700, "new"), (None, "new")], "id long, v string")
    existing = spark.read.parquet(path)
    name = f"{sinks.BUCKET}32"
    touched = {r[0] for r in sinks._bucketed(batch, ["id"], 32).select(name).collect()}
    fresh = sinks.unwritten(batch, existing, ["id"])
    assert len(touched) <= 3
    assert [r.id for r in fresh.collect()] == [700]
    scan = [line for line in plan_of(fresh).splitlines() if "FileScan" in line and "PartitionFilters" in line][0]
    assert name in scan.split("PartitionFilters: ")[1].split("]")[0]
    read = existing.where(F.col(name).isin(list(touched))).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= len(touched) < existing.select(F.input_file_name().alias("f")).distinct().count()
    sinks.append_new(batch, path, ["id"], buckets=7)  # later batches follow the dataset
    got = sinks.read_appended(spark, path)
    assert got.columns == ["id", "v"] and got.count() == 502 and got.where("v = 'new'").collect() == [(700, "new")]
    sinks.append_new(batch.limit(0), path, ["id"])
    assert sinks.read_appended(spark, path).count() == 502


def pixel_exchanges(df):
    """Exchanges by block that have pixel bytes below them."""
    lines, moved = plan_of(df).splitlines(), 0
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(image_id" in line and "by#" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            moved += any("data#" in x for x in lines[i + 1 : end])
    return moved


def test_aligned_block_tables_meet_without_moving_pixels(spark, make_blocks):
    src = {k: RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8) for k in range(3)}
    edit = {k: np.minimum(255, v.astype(int) + 9).astype(np.uint8) for k, v in src.items()}
    for name, images in (("blocks_before", src), ("blocks_after", edit)):
        sinks.write_block_table(make_blocks(images, 16), name, 4)
    try:
        before, after = spark.table("blocks_before"), spark.table("blocks_after")
        boxes = spark.createDataFrame([(k, 50, 40, 5, 5, 30, 30) for k in src], "image_id int, img_w int, img_h int, y0b int, x0b int, y1b int, x1b int")
        counters = quality.edit_counters(before, after, boxes, 16)
        plain = quality.edit_counters(make_blocks(src, 16), make_blocks(edit, 16), boxes, 16)
        assert pixel_exchanges(counters) == 0 and pixel_exchanges(plain) == 2
        assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        for name in ("blocks_before", "blocks_after"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 60), max_size=30), st.sampled_from([0.0, 0.015, 0.1, 0.5]))
def test_step_functions_are_the_fold(scores, epsilon):
    scores = np.array(scores, float) / 50
    limits, ends = curriculum.best_after(scores, epsilon)
    for start in [-1.0, *scores, *(scores - epsilon), 2.0]:
        want = start
        for s in scores:
            want = s if s > want + epsilon else want
        at = np.searchsorted(limits, start + epsilon, "right")
        assert (ends[at] if at < len(ends) else start) == want


def test_a_run_that_always_rises_spreads_over_tasks(spark):
    df = spark.range(1, 4001).select(F.lit(1).alias("run"), F.col("id").cast("int").alias("cycle"), (F.col("id") / 4000).alias("score"), F.lit("c").alias("checkpoint"))
    peaks = df.select("run", F.floor(F.col("cycle") / 100).alias("_chunk"), "cycle", "score")
    starts = {r["_chunk"]: r["_start"] for r in curriculum._starting_best(peaks, 0.01).collect()}
    best, want = -1.0, {}
    for c in range(1, 4001):
        want.setdefault(c // 100, best)
        best = c / 4000 if c / 4000 > best + 0.01 else best
    assert starts == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = peaks.repartition("run", "_chunk").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(chunks) > 1
    got = curriculum.reward_fold(df, 0.01, chunk=100)
    assert got.where("improved_global_best").count() == len(list(_improvements()))


def _improvements():
    best = -1.0
    for c in range(1, 4001):
        if c / 4000 > best + 0.01:
            best = c / 4000
            yield c


def test_a_model_is_made_once_per_worker(spark, tmp_path):
    log, weights = tmp_path / "made", tmp_path / "weights.txt"
    log.mkdir()
    weights.write_text("3.0")
    made = str(log)

    def make(path):
        import uuid

        factor = float(open(path).read())
        open(f"{made}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(batch):
            assert len(batch) <= 16
            return np.stack([factor * batch["x"], -batch["x"]], axis=1)

        return predict

    df = spark.range(400).select((F.col("id") % 7 - 3).cast("double").alias("x")).repartition(20)
    out = seams.batch_score(df, seams.PerWorker(spark, make, [str(weights)]), ["pos", "neg"], rows=16)
    rows = out.collect()
    assert len(rows) == 400 and all((r.pred_label == "pos") == (r.x >= 0) for r in rows)
    assert rows[0].probs == pytest.approx([1 / (1 + np.exp(-4 * rows[0].x)), 1 / (1 + np.exp(4 * rows[0].x))])
    out.collect()
    names = os.listdir(made)
    assert len(names) == len({n.split("-")[0] for n in names}) < 20


def test_maps_as_dictionary_literals(spark):
    rows = [('{"a": 1.5}', {"a": 1.5}), ("{'a': True, 'b': .5, 'c': 1.,}", {"a": 1.0, "b": 0.5, "c": 1.0}), ("{1: '2', 'x y': -3e2}", {"1": 2.0, "x y": -300.0}), ("{}", {}), ("", None), (None, None), ('{"a: True, b": 1}', {"a: True, b": 1.0})]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.m for r in df.select(coerce.float_map(F.col("t")).alias("m")).collect()] == [m for _, m in rows]
    for wrong in ("x", "[1]", "{'a': 'z'}", "{'a': None}", "{'a' 1}"):
        with pytest.raises(Exception, match="not a"):
            spark.createDataFrame([(wrong,)], "t string").select(coerce.float_map(F.col("t"))).collect()


def test_legacy_models_count_without_specs_only(spark):
    legacy = spark.createDataFrame([(2, "a", "/second"), (1, "a", "/first"), (3, "b", "null"), (4, "c", ""), (5, "d", None), (6, None, "/x")], "position int, alias string, path string")
    resolve = lambda *specs: joins.models_or_legacy(joins.resolve_models(spark.createDataFrame([(s,) for s in specs], "spec string")), legacy)
    assert [tuple(r) for r in resolve().collect()] == [("a", "/first")]
    assert [tuple(r) for r in resolve("z=/m").collect()] == [("z", "/m")]
    with pytest.raises(Exception, match="invalid"):
        resolve("z=/m", "nothing").collect()


def test_split_summary(spark):
    split = spark.createDataFrame([("train", 1), ("train", 1), ("train", 2)], "split string, volume int")
    history = spark.createDataFrame([(0.2,), (float("nan"),), (None,)], "val_f1 double")
    assert sampling.split_summary(split, "volume", history).collect() == [(3, 0, 2, 0, 0.2)]
    assert sampling.split_summary(split.limit(0), "volume", history.limit(0)).collect() == [(0, 0, 0, 0, -1.0)]


def test_samples_cut_their_groups_before_the_shuffle(spark):
    """A group limit in the plan: each task sends as many rows of a label as are asked for, not all of them."""
    from tessella.operators import sampling

    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 5 < 4 THEN concat('l', id % 5) END AS label")
    sample = sampling.stratified_sample(rows, "label", 7, 3, ["id"])
    assert sample._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert sample.groupBy("label").count().select("count").distinct().collect() == [(7,)]
    ranks = sampling.ordered_strata(rows, "label", 7, 3, ["id"])
    assert sorted(r.source_index for r in ranks.collect()) == list(range(35))


def test_kernels_in_a_row_share_a_worker(spark, make_blocks):
    rgb = {k: RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8) for k in range(4)}
    lut = np.array(list(roi.PALETTE), np.uint8)
    rgb[1] = lut[RNG.integers(0, len(lut), (40, 50))]
    made = make_blocks(rgb, 16)
    regions = roi.roi_blocks(roi.decode_palette(made, unknown=0), exclude=(5, 6))
    found = blocks.digest(regions)
    assert plan_of(found).count("MapInArrow") == 1
    soft = blocks.digest(masks.soften(regions, 16, 1.5))
    assert plan_of(soft).count("MapInArrow") == 2  # one on each side of the shuffle of the rims
    apart = blocks.digest(spark.createDataFrame(regions.collect(), regions.schema))
    assert sorted(found.collect()) == sorted(apart.collect())
    yy, xx = np.mgrid[0:40, 0:50]
    place = ((yy * 131 + xx * 7) % 1009 + 1)[:, :, None] + np.arange(3)
    got = {r.image_id: r for r in blocks.digest(made).collect()}
    for k, v in rgb.items():
        assert (got[k].n_values, got[k].sum_v, got[k].pos_sum) == (v.size, v.sum(), (v.astype(int) * place).sum())
    # a step in between that isn't a kernel goes to Spark again
    some = blocks.digest(regions.where("image_id > 1"))
    assert sorted(some.collect()) == [r for r in sorted(found.collect()) if r.image_id > 1]


@pytest.fixture
def boxed_tiles(spark):
    """Tiles of 10 x 8 in frames of 40 x 50 cut into blocks of 16: within a block, across blocks, beyond the frame, twice, outside."""
    at = [(0, 0), (3, 5), (6, 8), (7, 8), (12, 12), (34, 45), (38, 1), (-2, 0), (60, 60), (3, 5)]
    rows = [(k, y, x, x, y, x + 8, y + 10) for k in range(3) for y, x in at]
    return spark.createDataFrame(rows, "image_id int, tile_y int, tile_x int, x0 int, y0 int, x1 int, y1 int"), sorted(set(at[:8]))


@pytest.mark.parametrize("near", [0, 1_000_000])
def test_tiles_within_a_block_are_not_shuffled(spark, make_blocks, boxed_tiles, near, monkeypatch):
    monkeypatch.setattr(blocks, "NEAR", near)
    tiles, at = boxed_tiles
    src = {k: RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8) for k in range(3)}
    masked = {k: RNG.integers(0, 2, (40, 50)).astype(np.uint8) for k in range(3)}

    def want(arr, y, x):
        out = np.zeros((10, 8) + arr.shape[2:], np.uint8)
        part = arr[max(0, y) : y + 10, max(0, x) : x + 8]
        out[max(0, -y) : max(0, -y) + part.shape[0], max(0, -x) : max(0, -x) + part.shape[1]] = part
        return out.tobytes()

    keys = ["image_id", "tile_y", "tile_x"]
    got = blocks.crop_tiles(tiles, make_blocks(src, 16), 16, keys)
    assert sorted(map(tuple, got.select(*keys, "data").collect())) == [(k, y, x, want(src[k], y, x)) for k in src for y, x in at]
    pairs = patches.labelled_crops(tiles, make_blocks(src, 16), make_blocks(masked, 16), 16, keys)
    assert sorted(map(tuple, pairs.select(*keys, "nch", "data", "mask").collect())) == [(k, y, x, 3, want(src[k], y, x), want(masked[k], y, x)) for k in src for y, x in at]
    inside = blocks.crop_tiles(tiles.where("tile_y = 3"), make_blocks(src, 16), 16, keys)
    assert "piece#" not in plan_of(inside) and inside.count() == 3
    across = blocks.crop_tiles(tiles.where("tile_y = 12"), make_blocks(src, 16), 16, keys)
    assert "piece#" in plan_of(across) and across.count() == 3


def test_crops_are_resized_without_a_shuffle(spark, make_blocks, boxed_tiles):
    src = {k: RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8) for k in range(3)}
    keys = ["image_id", "tile_y", "tile_x"]
    crops = spark.createDataFrame(blocks.crop_tiles(boxed_tiles[0], make_blocks(src, 16), 16, keys).collect())
    small = resample.resize_crops(crops, 7, 5, "lanczos", keys)
    assert "Exchange" not in plan_of(small)
    zero = F.lit(0).cast("int")
    images = crops.withColumns({c: zero for c in ("by", "bx", "y0", "x0")}).withColumns({f"img_{c}": F.col(c) for c in "hw"}).drop("data").join(crops.select(*keys, "data"), keys)
    shares = resample.resize_linear(images, 16, lambda b: (7, 5), "lanczos", keys=keys)
    columns = [*keys, "y0", "x0", "h", "w", "img_h", "img_w", "nch", "data"]
    assert sorted(map(tuple, small.select(*columns).collect())) == sorted(map(tuple, shares.select(*columns).collect()))


def test_histograms_of_single_block_images_are_moments(spark, make_blocks):
    sizes = {0: (16, 16), 1: (9, 12), 2: (40, 50), 3: (16, 17), 4: (5, 5)}
    src = {k: RNG.integers(0, 256, (*s, 3)).astype(np.uint8) for k, s in sizes.items()}
    src[4][:] = 7  # a flat histogram
    edit = {k: (v // 2 + 40).astype(np.uint8) for k, v in src.items()}
    boxes = spark.createDataFrame([(k, w, h, 2, 2, h, w - 1) for k, (h, w) in sizes.items()], "image_id int, img_w int, img_h int, y0b int, x0b int, y1b int, x1b int")
    made = [quality.edit_counters(make_blocks(src, 16), make_blocks(edit, 16), boxes, 16, moments=m) for m in (False, True)]
    bins = [{r["image_id"]: r["count"] for r in m.groupBy("image_id").count().collect()} for m in made]
    assert max(bins[1][k] for k in (0, 1, 4)) <= 6 < min(bins[0][k] for k in (0, 1)) and bins[0][2] == bins[1][2]
    plain, packed = (sorted(map(tuple, quality.edit_metrics(m).collect())) for m in made)
    assert plain == packed
