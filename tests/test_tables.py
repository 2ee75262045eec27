"""Functions, sources, samples, joins and the loop on small tables."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import boxes, coerce, labels, naming, prompts, scores
from tessella.operators import curriculum, joins, metrics, ranking, sampling, seams
from tessella.sources import listings, manifest, sinks, tables
from tessella.streaming.ingest import ingest_new, stream_files


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names(spark):
    assert column(spark, ["MD22-04144(B1-3)", "a-7", "plain", "x-y-12"], naming.volume_id) == ["MD22-04144(B1)", "a", "plain", "x-y"]
    assert column(spark, ["MD22-04144(B1-3)", "a-7", "plain", "x-y-12"], naming.slice_index) == [3, 7, -1, 12]
    assert column(spark, ["q(B1-3)", "q(B1-12)", "none"], naming.group_code) == ["B", "UNK", "UNK"]
    assert column(spark, ["/a/b.c.PNG", "/a/b/", ".hidden", "x."], naming.path_name) == ["b.c.PNG", "b", ".hidden", "x."]
    assert column(spark, ["b.c.PNG", "b", ".hidden", "x."], naming.name_suffix) == [".PNG", "", "", ""]
    assert column(spark, ["/a/b.c.PNG"], naming.stem_key) == ["b.c"]
    assert column(spark, ["é-1 b", "__", ""], naming.safe_name) == ["é-1_b", "item", "item"]
    assert column(spark, ["a=/x=y", "=/x", "a=", "no"], naming.model_alias) == ["a", None, "a", None]
    assert column(spark, ["a=/x=y", "=/x", "a=", "no"], naming.model_path) == ["/x=y", "/x", None, None]


def plain_category(text):
    text = unicodedata.normalize("NFD", text.strip()).encode("ascii", "ignore").decode("ascii").casefold()
    return __import__("re").sub(r"\s+", " ", text)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), min_size=1, max_size=20))
def test_category_equals_unicode_rules(spark, texts):
    texts = texts + ["  Doenças\tinfecciosas \n", "Straße ≠ Ǻ", "  x "]
    assert column(spark, texts, labels.normalise_category) == [plain_category(t) for t in texts]


def test_tokens_and_modes(spark):
    raw = ["Doenças infecciosas", "opmd", "benign  lesion", "??", "Neoplasias malignas", "Doenças potencialmente malignas"]
    got = column(spark, raw, lambda c: labels.label_token(labels.normalise_category(c)))
    assert got == ["benign_lesion", "opmd", "benign_lesion", "benign_lesion", "cancer", "opmd"]
    assert all(labels.plain_category(k) == plain_category(k) for k in labels.CATEGORY_TOKENS)
    assert column(spark, ["In-Paint", "txt2_img", None], labels.normalise_mode) == ["inpaint", "text2image", "text2image"]
    with pytest.raises(PySparkException):
        column(spark, ["other"], labels.normalise_mode)


def test_coercion(spark):
    raw = ["", "null", "nan", "12.7", " -3 ", "x", None, "1d", "1e2", ".5", "inf"]
    assert column(spark, raw, coerce.to_float) == [None, None, None, 12.7, -3.0, None, None, None, 100.0, 0.5, None]
    assert column(spark, raw, coerce.to_int) == [None, None, None, 12, -3, None, None, None, 100, 0, None]
    assert column(spark, ["1, 2,,1", None], coerce.id_list) == [[1, 2], []]
    assert column(spark, ['{"a": -2, "b": 3}'], coerce.repeat_map) == [{"a": 0, "b": 3}]


def test_prompts(spark):
    assert column(spark, ["cancer", "x"], lambda c: prompts.render("{token}{descriptor_suffix} ", c, {"cancer": " dense "})) == ["cancer, dense", "x"]
    assert column(spark, ["a Tissue  Pattern: ok_1 z", "last word\n", "  "], prompts.caption_token) == ["ok_1", "word", "benign_lesion"]
    assert column(spark, ["0001_3_77.png", "x", "a_b_c.png"], prompts.prompt_index) == [3, None, None]


def test_boxes(spark):
    rows = [("5", "6", "64", None, "0"), (None, "6", "64", "1", "1"), ("5", "6", None, None, "3"), ("900", "-4", "64", "8", "8")]
    df = spark.createDataFrame(rows, "x string, y string, s string, w string, h string")
    args = [F.col(c) for c in "xyswh"]
    got = df.select(boxes.crop_box(*args).alias("c"), boxes.clamp_box(boxes.crop_box(*args), F.lit(100), F.lit(50)).alias("k"), boxes.tile_box(*args).alias("t")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [(5, 6, 69, 70), None, None, (900, -4, 908, 4)]
    assert [tuple(r.k) if r.k else None for r in got] == [(5, 6, 69, 50), None, None, (99, 0, 100, 4)]
    assert tuple(got[1].t) == (0, 6, 1, 7) and tuple(got[2].t) == (5, 6, 517, 9)


def test_scores(spark):
    classes = ["a", "b", "c"]
    df = spark.createDataFrame([([1.0, 1.0, -4.0],), ([700.0, 0.0, 0.0],)], "l array<double>").withColumn("p", scores.softmax(F.col("l")))
    got = df.select(scores.predicted(F.col("p"), classes).alias("y"), F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("s"), scores.probability_of(F.col("p"), F.lit("zzz"), classes).alias("u")).collect()
    assert [r.y for r in got] == ["a", "a"] and all(abs(r.s - 1) < 1e-12 and r.u is None for r in got)


def test_csv_by_header_and_missing_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("tile_x, filename ,extra\n12.7,a.png,1\nnull,b.png,2\n")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), "filename string, tile_x int, tile_white_frac double", ["filename"])
    assert [tuple(r) for r in df.orderBy("filename").collect()] == [("a.png", None, None), ("b.png", None, None)]
    with pytest.raises(ValueError, match="coarse_label"):
        tables.read_csv(spark, str(tmp_path / "t.csv"), required=["coarse_label"])
    assert tables.first_present(df, ["label", "filename"]) == "filename"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"version": 2, "files": [{"filename": "b.JPG", "id": "1", "content_details": {"size": 5, "download_url": "u"}},'
        '\n {"filename": "a.png", "id": "2", "content_details": null}, {"filename": "x.txt", "id": "3"}, {"filename": "nodot", "id": "4"}]}'
    )
    m = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    files = manifest.flatten_manifest(m, [".JPG", "png "])
    assert sorted((r.filename, r.size_bytes) for r in files.collect()) == [("a.png", 0), ("b.JPG", 5)]
    assert manifest.flatten_manifest(m, []).count() == 3
    assert manifest.manifest_summary(files, 1).collect()[0].total_size_bytes == 0
    assert manifest.expect_version(m, 2).count() == 1
    with pytest.raises(PySparkException):
        manifest.expect_version(m, 3).collect()


def test_checkpoint_order(spark):
    names = ["last.safetensors", "epoch-10.safetensors", "epoch-9.safetensors", "at-step5.safetensors", "zed.safetensors"]
    df = spark.createDataFrame([("r", n, 5 - i) for i, n in enumerate(names)] + [("only", "last.safetensors", 1)], "run string, name string, mtime int")
    order = lambda d: [r.name for r in d.where("run = 'r'").orderBy("position").collect()]
    stems = lambda got: [n.removesuffix(".safetensors") for n in got]
    assert stems(order(listings.checkpoints(df, "run", "name"))) == ["epoch-9", "epoch-10", "at-step5", "last", "zed"]
    assert stems(order(listings.checkpoints(df, "run", "name", steps=False))) == ["epoch-9", "epoch-10", "last", "at-step5", "zed"]
    assert stems(order(listings.checkpoints(df, "run", "name", include_last=False, latest=2))) == ["at-step5", "zed"]
    timed = listings.checkpoints_by_time(df, "run", "name", "mtime")
    assert stems(order(timed)) == ["zed", "at-step5", "epoch-9", "epoch-10"] and timed.where("run = 'only'").count() == 1
    with pytest.raises(PySparkException):
        listings.explicit_checkpoints(df.select("run", F.lit("ghost").alias("names")), df, "run", "names", "name").collect()


def test_positions_and_ranks_ignore_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 5) END AS g")
    for n in (1, 7):
        got = {(r.g, r.id): r.p for r in sampling.with_position(df.repartition(n), ["id"], "p", by=["g"]).collect()}
        for g in {k[0] for k in got}:
            ids = sorted(i for h, i in got if h == g)
            assert [got[(g, i)] for i in ids] == list(range(len(ids)))
    whole = {r.id: r.p for r in sampling.with_position(df.repartition(5), ["id"], "p").collect()}
    assert whole == {i: i for i in range(1000)}
    ranks = sampling.hash_rank(df, F.md5(F.col("id").cast("string")), by=["g"], ties=["id"]).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in ranks.collect())


def test_samples(spark):
    df = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'a' ELSE 'b' END AS label")
    a = {r.id for r in sampling.stratified_sample(df, "label", 150, 1, ["id"]).collect()}
    assert len([i for i in a if i < 200]) == 150 and len([i for i in a if i >= 200]) == 100
    assert a == {r.id for r in sampling.stratified_sample(df.repartition(9), "label", 150, 1, ["id"]).collect()}
    assert a != {r.id for r in sampling.stratified_sample(df, "label", 150, 2, ["id"]).collect()}
    assert sampling.exact_sample(df, 7, 1, ["id"]).count() == 7 and sampling.exact_sample(df, 0, 1, ["id"]).count() == 300
    rest = sampling.holdout_sample(df, sampling.stratified_sample(df, "label", 150, 1, ["id"]), "label", 500, 3, ["id"])
    assert {r.id for r in rest.collect()} == set(range(300)) - a
    idx = sampling.ordered_strata(df, "label", 60, 1, ["id"]).orderBy("source_index").collect()
    assert [r.source_index for r in idx] == list(range(120)) and [r.label for r in idx] == ["a"] * 60 + ["b"] * 60


def test_split_keeps_groups_whole(spark):
    df = spark.range(500).selectExpr("id", "id % 23 AS volume")
    out = sampling.group_split(df, "volume", 0.2, 4)
    assert out.count() == 500 and out.groupBy("volume").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("split = 'val'").select("volume").distinct().count() == 5


def test_draws_balance_classes(spark):
    df = spark.range(1100).selectExpr("id", "CASE WHEN id < 1000 THEN 'big' ELSE 'small' END AS label")
    got = {r.label: r["count"] for r in sampling.weighted_draw(df, "label", 2000, 1, ["id"]).groupBy("label").count().collect()}
    assert sum(got.values()) == 2000 and abs(got["big"] - 1000) < 120


def plain_fold(values, eps, patience, revert=True):
    best, ckpt, idle, out = -1.0, None, 0, []
    for cycle, (score, name) in enumerate(values, 1):
        improved = score > best + eps
        if improved:
            best, ckpt, idle = score, name, 0
        else:
            idle += 1
        back = bool(revert and ckpt is not None and score + eps < best)
        out.append((cycle, improved, best, ckpt, idle, back, ckpt if back else name))
        if patience > 0 and idle >= patience:
            break
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(-30, 60), min_size=1, max_size=40), min_size=1, max_size=5), st.integers(0, 4), st.sampled_from([0.0, 0.015, 0.1]), st.sampled_from([2, 7, 4096]))
def test_reward_fold_equals_plain_loop(spark, runs, patience, eps, chunk):
    rows = [(i, c, s / 50, f"c{c}") for i, run in enumerate(runs) for c, s in enumerate(run, 1)]
    df = spark.createDataFrame(rows, "run int, cycle int, score double, checkpoint string")
    got = curriculum.reward_fold(df, eps, patience, chunk=chunk).orderBy("run", "cycle").collect()
    for i, run in enumerate(runs):
        mine = [(r.cycle, r.improved_global_best, r.global_best, r.global_best_checkpoint, r.no_improve, r.reverted, r.next_start_checkpoint) for r in got if r.run == i]
        assert mine == plain_fold([(s / 50, f"c{c}") for c, s in enumerate(run, 1)], eps, patience)


def test_curriculum_rules(spark):
    rows = [("cross_class", "cancer", 0.5, 0.9, "k"), ("cross_class", "opmd", None, 0.9, "k"), ("cross_class", "opmd", 0.5, None, "k"), ("same_class", "opmd", None, 0.05, "k"), ("same_class", "opmd", None, 0.5, "k 1")]
    df = spark.createDataFrame(rows, "prompt_mode string, target_label string, target_source_prob_margin double, target_prob double, source_key string")
    rules = curriculum.Rules(2, 1, 0.1, 0.2, 0.1, {"cancer": 3})
    stats = curriculum.curriculum_stats(curriculum.judge_rows(df, rules)).collect()[0].asDict()
    assert stats == {"pseudo_rows_kept": 4, "pseudo_cross_rows": 1, "pseudo_same_rows": 1, "pseudo_dropped_cross_margin": 1, "pseudo_dropped_cross_prob": 1, "pseudo_dropped_same_prob": 1}
    assert sorted(r.stem for r in curriculum.curriculum_rows(df, rules).collect()) == [
        "cross_class_k__to__cancer__r01", "cross_class_k__to__cancer__r02", "cross_class_k__to__cancer__r03", "same_class_k_1__to__opmd__r01"]
    assert curriculum.curriculum_rows(df, curriculum.Rules(0, 0)).count() == 0


def test_metrics_edges(spark):
    empty = spark.createDataFrame([("a", None, 0.5)], "pred_label string, expected_label string, confidence double")
    row = metrics.consistency(empty).collect()[0]
    assert row.consistency_top1 is None and row.n_images == 1
    assert metrics.macro_consistency(metrics.class_accuracy(empty), ["a"]).collect()[0].macro_consistency == 0.0
    none = spark.createDataFrame([(0, 0, 0.5)], "y int, p int, q double")
    assert metrics.evaluate_binary(none, "y", "p", "q").collect()[0].val_f1 == 0.0
    vocab = metrics.label_vocabulary([spark.createDataFrame([("b",), ("a",), (None,)], "l string")], "l")
    assert metrics.resolve_classes(vocab, 2, ["x"], labels.TOKENS) == ["a", "b"]
    assert metrics.resolve_classes(vocab, 1, ["x"], labels.TOKENS) == ["x"]
    assert metrics.resolve_classes(vocab, 4, ["x"], labels.TOKENS) == sorted(labels.TOKENS)
    assert metrics.resolve_classes(vocab, 3, ["x"], labels.TOKENS) == ["class_0", "class_1", "class_2"]
    assert metrics.resolve_classes(vocab, None, ["x"], labels.TOKENS) == ["a", "b"]


def test_ranking_ties_keep_listing_order(spark):
    df = spark.createDataFrame([("x", 0.5, 0.1, 1), ("y", 0.5, 0.1, 0), ("z", 0.4, 0.9, 2)], "checkpoint string, macro_consistency double, consistency_top1 double, position bigint")
    ranked = ranking.rank_candidates(df, ranking.CONSISTENCY_KEYS).orderBy("rank").collect()
    assert [r.checkpoint for r in ranked] == ["y", "x", "z"]
    assert ranking.best_candidate(df, ranking.CONSISTENCY_KEYS).collect()[0].checkpoint == "y"
    epochs = spark.createDataFrame([(1, 1.0, 0.5), (1, 2.0, 0.7), (1, 3.0, 0.7)], "run int, epoch double, val_f1 double")
    assert ranking.best_epoch(epochs, ["run"]).collect()[0].best_epoch == 2.0


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "m.png", "i.jpg"), (2, "", "j.jpg"), (3, "q.png", "k.jpg")], "k int, mask string, image string")
    listed = spark.createDataFrame([("i.jpg",), ("j.png",), ("j.jpeg",)], "name string")
    got = joins.first_existing(rows, "k", joins.mask_candidates(F.col("mask"), F.col("image")), listed, "name")
    assert {r.k: r.resolved for r in got.collect()} == {1: "i.jpg", 2: "j.png", 3: None}
    report = joins.missing_report(rows, rows.where("k = 2"), "k", "image").collect()[0]
    assert report.n_missing == 2 and report.examples == ["i.jpg", "k.jpg"]


def test_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5).withColumn("v", F.lit(1))
    sinks.append_new(df, path, ["id"])
    sinks.append_new(spark.range(8).withColumn("v", F.lit(2)), path, ["id"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {i: 1 if i < 5 else 2 for i in range(8)}
    sinks.append_new(df.limit(1), path, ["id"], overwrite=True)
    assert spark.read.parquet(path).count() == 1
    sinks.write_summary(df.agg(F.count("*").alias("rows"), F.lit(None).cast("double").alias("mean")), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).collect()[0].value == '{"rows":5,"mean":null}'
    sinks.write_csv(spark.range(20).select(F.col("id"), F.lit('a "b", c').alias("t")), str(tmp_path / "c"), ["id"])
    back = tables.read_csv(spark, str(tmp_path / "c"), "id int, t string")
    assert [(r.id, r.t) for r in back.orderBy("id").collect()] == [(i, 'a "b", c') for i in range(20)]


def test_stream_runs_twice_without_copies(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(0, 6).withColumn("v", F.lit("first")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest_new(stream_files(spark, src, schema), out, state, ["id"], ["v"])
    spark.range(4, 9).withColumn("v", F.lit("second")).write.mode("append").parquet(src)
    ingest_new(stream_files(spark, src, schema), out, state, ["id"], ["v"])
    ingest_new(stream_files(spark, src, schema), out, str(tmp_path / "lost"), ["id"], ["v"])  # state lost: still no copies
    assert {r.id: r.v for r in spark.read.parquet(out).collect()} == {i: "first" if i < 6 else "second" for i in range(9)}


def test_model_seam(spark):
    import numpy as np

    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "image_path string, x double")
    out = seams.batch_score(df, lambda b: np.stack([b["x"], -b["x"]], axis=1), ["pos", "neg"])
    assert {r.image_path: r.pred_label for r in out.collect()} == {"a": "pos", "b": "neg"}


def test_checks_survive_projection(spark):
    m = spark.createDataFrame([(1, "a")], "version int, files string")
    with pytest.raises(PySparkException):
        manifest.expect_version(m, 2).select("files").collect()
    requests = spark.createDataFrame([("r", "a, gone")], "run string, names string")
    listing = spark.createDataFrame([("r", "a")], "run string, name string")
    with pytest.raises(PySparkException):
        listings.explicit_checkpoints(requests, listing, "run", "names", "name").select("run", "wanted").collect()
    assert listings.explicit_checkpoints(requests, listing, "run", "names", "name", strict=False).count() == 2


def test_large_vocabulary_is_whole(spark):
    found = metrics.resolve_classes(spark.range(10_050).select(F.format_string("l%06d", "id").alias("label")), None, [], [])
    assert len(found) == 10_050 and found[-1] == "l010049"


def test_history_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        sinks.conform(spark.createDataFrame([(1, 2)], "cycle int, odd int"), "cycle int")


def test_log_loss_of_certain_errors(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 0, 0.0)], "y int, p int, q double")
    assert metrics.evaluate_binary(rows, "y", "p", "q").first().val_loss == pytest.approx(13.8155, abs=1e-3)


def test_malformed_json_fails(spark):
    assert column(spark, ["", None, '{"a": 1}'], coerce.float_map) == [None, None, {"a": 1.0}]
    for text in ("{bad", "[1]", "3"):
        with pytest.raises(PySparkException):
            column(spark, [text], coerce.float_map)


def test_image_names_are_decoded(spark, tmp_path):
    import numpy as np

    from tessella.checks.png import encode_png
    from tessella.sources.images import scan_images, unreadable_images

    names = ["p%q.png", "s[1].png", "a b.png", "c#d.png", "e+f.png", "ü.png"]
    for n in names:
        (tmp_path / n).write_bytes(encode_png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"x")
    got = {r.image_id for r in scan_images(spark, str(tmp_path), skip_unreadable=True).collect()}
    assert got == set(names) <= {r.filename for r in listings.list_folder(spark, str(tmp_path)).collect()}
    assert [r.filename for r in unreadable_images(spark, str(tmp_path)).collect()] == ["broken.png"]
    with pytest.raises(PySparkException):
        scan_images(spark, str(tmp_path)).collect()


def test_missing_read_errors_are_not_hidden(spark, tmp_path):
    assert sinks.read_if_exists(spark, str(tmp_path / "none")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(PySparkException):
        sinks.read_if_exists(spark, str(tmp_path / "empty"))


def test_maps_are_parsed_once(spark):
    """Each parse stands in the expression a fixed number of times, also with maps on top of maps."""
    from pyspark.sql import functions as F

    from tessella.functions import coerce

    rows = spark.createDataFrame([('{"a": 1.5, "b": "2"}',), ("{'a': .5, 2: True,}",), ("  ",), (None,)], "t string")
    shifted = F.to_json(F.transform_values(coerce.float_map(F.col("t")), lambda _, v: v + 1))
    found = rows.select(coerce.float_map(F.col("t")).alias("f"), coerce.repeat_map(shifted).alias("n"))
    assert found._jdf.queryExecution().analyzed().toString().count("from_json") <= 8
    assert [tuple(r) for r in found.collect()] == [({"a": 1.5, "b": 2.0}, {"a": 2, "b": 3}), ({"a": 0.5, "2": 1.0}, {"a": 1, "2": 2}), (None, None), (None, None)]
