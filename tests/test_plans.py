"""Whole plans on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import curriculum
from tessella.plans import benchmark, mining, patches, reward_loop

RNG = np.random.default_rng(11)


def test_mining_limits_and_funnel(spark, make_blocks):
    mask = {0: (RNG.random((60, 80)) < 0.5).astype(np.uint8) * 255, 1: np.zeros((60, 80), np.uint8), 2: np.full((10, 80), 255, np.uint8)}
    rgb = {k: np.full((*m.shape, 3), 255 if k == 9 else 20, np.uint8) for k, m in mask.items()}
    rgb[0][:, 40:] = 255
    images = spark.createDataFrame([(k, f"s{k}", m.shape[1], m.shape[0]) for k, m in mask.items()], "image_id int, stem string, w int, h int")
    p = mining.Mining(size=16, stride=8, per_image=20, max_white=0.3)
    blocks = make_blocks(mask, 16), make_blocks(rgb, 16)
    rows = mining.mine_tiles(images, *blocks, p).collect()
    assert {r.image_id for r in rows} == {0} and all(r.tile_white_frac <= 0.3 and 0.15 <= r.tile_mask_coverage <= 0.95 for r in rows)
    for r in rows:
        win = (slice(r.tile_y, r.tile_y + 16), slice(r.tile_x, r.tile_x + 16))
        assert r.tile_mask_coverage == (mask[0][win] > 0).mean() and r.tile_white_frac == (rgb[0][win] >= 235).all(axis=2).mean()
        assert r.filename == f"s0__x{r.tile_x:05d}_y{r.tile_y:05d}_s16.png"
    counts = mining.mining_funnel(images, mining.selected_tiles(images, *blocks, p), p).collect()[0]
    assert (counts.skipped_small, counts.selected_before_white, counts.kept, counts.dropped_by_white) == (1, 20, len(rows), 20 - len(rows))
    off = mining.mine_tiles(images, *blocks, mining.Mining(size=16, stride=8, per_image=0)).collect()
    assert all(r.tile_white_frac is None for r in off) and len(off) > 20
    few = mining.mine_tiles(images, *blocks, mining.Mining(size=16, stride=8, per_image=0, total=7))
    assert few.count() == 7
    everything = mining.mine_tiles(images, *blocks, mining.Mining(size=16, stride=8, per_image=0, min_cover=0.0, max_cover=1.0))
    assert everything.where("image_id = 1 AND tile_mask_coverage = 0").count() == 63


@pytest.mark.parametrize("block", [8, 64])
def test_mining_does_not_depend_on_the_block_size(spark, make_blocks, block):
    mask = {0: (RNG.random((60, 80)) < 0.5).astype(np.uint8)}
    images = spark.createDataFrame([(0, "s", 80, 60)], "image_id int, stem string, w int, h int")
    p = mining.Mining(size=16, stride=6, per_image=0)
    a = {(r.tile_y, r.tile_x, r.tile_mask_coverage) for r in mining.mine_tiles(images, make_blocks(mask, block), None, p).collect()}
    b = {(r.tile_y, r.tile_x, r.tile_mask_coverage) for r in mining.mine_tiles(images, make_blocks(mask, 13), None, p).collect()}
    assert a == b and len(a) > 0


def test_edit_is_pasted_and_judged(spark, make_blocks, read_blocks):
    src = {0: RNG.integers(0, 256, (48, 48, 3)).astype(np.uint8)}
    edit = {0: np.zeros((24, 20, 3), np.uint8)}
    boxes = spark.createDataFrame([(0, 48, 48, 10, 12, 34, 32)], "image_id int, img_w int, img_h int, y0b int, x0b int, y1b int, x1b int")
    merged, verdict = patches.paste_and_judge(make_blocks(src, 16), make_blocks(edit, 16), boxes, 16, radius=0)
    out = read_blocks(merged)[0]
    assert (out[10:34, 12:32] == 0).all() and np.array_equal(out[:10], src[0][:10])
    row = verdict.collect()[0]
    assert row.non_roi_drift == 0 and row.mask_coverage > 0.9 and not row.passed and row.rejection_reasons[0].startswith("seam_quality")


def test_benchmark_rows(spark):
    rows = [(f"/i/{n}.jpg", "" if n % 2 else f"{n}.jpg", f"/m/{n}.png" if n % 3 == 0 else "", "cancer" if n < 12 else "non_cancer", 8 * n, 0, 64, None, None) for n in range(20)]
    df = spark.createDataFrame(rows, "image_path string, filename string, mask_path string, coarse_label string, tile_x int, tile_y int, tile_size int, tile_w int, tile_h int")
    names = spark.createDataFrame([(f"{n}.jpg",) for n in range(0, 20, 2)], "mask_name string")
    paths = spark.createDataFrame([(f"/m/{n}.png",) for n in range(0, 20, 3)], "mask_path string")
    p = benchmark.Benchmark(["cancer", "non_cancer"], sources_per_class=4, descriptors={"cancer": "dense"}, target_strength={"cancer": 0.9})
    df = df.withColumn("filename", F.when(F.col("filename") == "", F.regexp_extract("image_path", "([^/]*)$", 1)).otherwise(F.col("filename")))
    sources = benchmark.select_sources(df, "coarse_label", names, paths, p)
    got = sources.orderBy("source_index").collect()
    assert [r.source_index for r in got] == list(range(8)) and [r.coarse_label for r in got] == ["cancer"] * 4 + ["non_cancer"] * 4
    assert all(int(r.mask_name[:-4]) % 2 == 0 or int(r.mask_name[:-4]) % 3 == 0 for r in got)
    tasks = benchmark.benchmark_tasks(sources, "coarse_label", "/masks/", {"a": "/c/a", "b": "/c/b"}, p)
    assert tasks.count() == 8 * 2 * 2
    one = tasks.where("source_index = 5 AND target_label = 'cancer' AND model_alias = 'b'").collect()[0]
    assert (one.prompt_mode, one.strength, one.seed, one.prompt, one.lora_checkpoint) == ("cross_class", 0.9, 42 + 5000, "photo, diagnosis: cancer, dense", "/c/b")
    assert one.tile_w == 64 and one.generated_path == f"generated/b/{one.source_key}__to__cancer.png"
    scored = benchmark.score_tasks(tasks, lambda b: np.tile([1.0, 0.0], (len(b), 1)), ["cancer", "non_cancer"], tasks.where("source_index = 0"))
    assert scored.where("reused_existing").count() == 4 and scored.where("target_correct").count() == 16
    assert scored.where("target_source_prob_margin IS NULL").count() == 16


def test_reward_loop(spark):
    rows = []
    for cycle, good in ((1, 0.6), (2, 0.9), (3, 0.3)):
        for ck, shift in (("x", 0.0), ("y", -0.1)):
            for src in ("cancer", "non_cancer"):
                for tgt in ("cancer", "non_cancer"):
                    mode = "same_class" if src == tgt else "cross_class"
                    prob = good + shift
                    rows.append((1, cycle, ck, 0 if ck == "x" else 1, mode, src, tgt, tgt if prob > 0.5 else src, prob, 1 - prob, None if src == tgt else 2 * prob - 1, f"s{src}", f"p {tgt}"))
    scored = spark.createDataFrame(rows, "run int, cycle int, checkpoint string, position int, prompt_mode string, source_label string, target_label string, pred_label string, "
                                   "target_prob double, source_prob double, target_source_prob_margin double, source_key string, prompt string")
    ranked = reward_loop.rank_checkpoints(scored)
    assert {(r.cycle, r.checkpoint) for r in ranked.where("rank = 1").collect()} == {(1, "x"), (2, "x"), (3, "x")}
    history = reward_loop.loop_history(ranked, 0.01)
    state = {r.cycle: r for r in history.collect()}
    assert [state[c].improved_global_best for c in (1, 2, 3)] == [True, True, False] and state[3].reverted and state[3].global_best_cycle == 2
    anchors = spark.createDataFrame([(1, "real_000000_a", "cap", "kept"), (1, "real_000001_b", "cap", "missing_mask")], "run int, stem string, caption string, status string")
    made = reward_loop.next_curriculum(history, scored, anchors, curriculum.Rules(2, 1, min_cross_margin=0.1)).collect()
    count = lambda c, o: len([r for r in made if r.for_cycle == c and r.origin == o])
    assert [count(c, "real") for c in (1, 2, 3)] == [1, 1, 1]
    assert [count(c, "pseudo") for c in (1, 2, 3)] == [6, 6, 6]  # cycle 3 falls back to the rows of cycle 2


def test_tile_sized_masks_are_taken_whole(spark, make_blocks):
    rgb = {k: RNG.integers(0, 256, (40, 48, 3)).astype(np.uint8) for k in (0, 1)}
    mask = {0: (RNG.random((40, 48)) < 0.5).astype(np.uint8) * 255, 1: (RNG.random((16, 16)) < 0.5).astype(np.uint8) * 255}
    tiles = spark.createDataFrame([(k, 8, 4, 16, None, None) for k in (0, 1)], "image_id int, tile_y int, tile_x int, tile_size int, tile_w int, tile_h int")
    images = spark.createDataFrame([(k, 48, 40) for k in (0, 1)], "image_id int, w int, h int")
    _, masks = patches.source_inputs(tiles, images, make_blocks(rgb, 16), make_blocks(mask, 16), 16, 16, 16)
    got = {r.image_id: np.frombuffer(r.data, np.uint8).reshape(16, 16) for r in masks.collect()}
    assert np.array_equal(got[0], mask[0][8:24, 4:20]) and np.array_equal(got[1], mask[1])
