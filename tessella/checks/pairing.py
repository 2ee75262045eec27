"""Sources, sinks, pairing and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check, table
from tessella.checks.scalars import NAMED, VOLUME_SQL
from tessella.functions import labels, naming
from tessella.operators import joins, metrics, roi, sampling
from tessella.session import new_path
from tessella.sources import listings, manifest, sinks, tables

FILES_SQL = """files AS (SELECT page_id, concat('f', CAST(page_id AS VARCHAR), CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '' END) AS filename,
  CASE WHEN page_id % 11 <> 0 THEN url END AS download_url, CASE WHEN page_id % 7 <> 0 THEN CAST(length(html) AS BIGINT) ELSE 0 END AS size_bytes FROM pages),
kept AS (SELECT * FROM files WHERE lower(filename) LIKE '%.jpg' OR lower(filename) LIKE '%.png')"""


def _manifest(spark, sf):
    """Nested manifests of ten files each, from the page table."""
    entry = F.expr("""named_struct('filename', concat('f', page_id, CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '' END), 'id', cast(page_id as string),
      'content_details', named_struct('download_url', CASE WHEN page_id % 11 <> 0 THEN url END, 'view_url', url, 'sha256_hash', sha2(html, 256), 'content_type', 'x',
        'size', CASE WHEN page_id % 7 <> 0 THEN cast(length(html) as bigint) END))""")
    pages = table(spark, sf, "pages")
    return pages.groupBy(F.expr("page_id div 10").alias("dataset")).agg(F.collect_list(entry).alias("files"), F.lit(2).alias("version"))


@check("manifest_flatten", f"WITH {FILES_SQL} SELECT filename, CAST(page_id AS VARCHAR) AS file_id, download_url, size_bytes FROM kept ORDER BY filename")
def manifest_flatten(spark, sf):
    return manifest.flatten_manifest(_manifest(spark, sf)).select("filename", "file_id", "download_url", "size_bytes").orderBy("filename")


@check("manifest_summary", f"WITH {FILES_SQL} SELECT a.file_count, a.total_size_bytes, b.file_count AS first_count, b.total_size_bytes AS first_size FROM (SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM kept) a, "
       "(SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM (SELECT * FROM kept ORDER BY filename LIMIT 20) q) b")
def manifest_summary(spark, sf):
    files = manifest.flatten_manifest(_manifest(spark, sf))
    first = manifest.manifest_summary(files, 20).toDF("first_count", "first_size")
    both = manifest.manifest_summary(files).unionByName(first, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@check("manifest_expect", "SELECT page_id // 10 AS dataset, 2 AS version FROM pages GROUP BY ALL")
def manifest_expect(spark, sf):
    return manifest.expect_version(_manifest(spark, sf), 2).select("dataset", "version")


@check("fetch_plan", f"""WITH {FILES_SQL} SELECT status, count(*) AS n FROM (SELECT CASE WHEN download_url IS NULL THEN 'missing_url' WHEN page_id % 3 = 0 AND (size_bytes <= 0 OR page_id % 6 <> 0) THEN 'skip' ELSE 'fetch' END AS status FROM kept) q GROUP BY status""")
def fetch_plan(spark, sf):
    files = manifest.flatten_manifest(_manifest(spark, sf))
    existing = files.where("cast(file_id as bigint) % 3 = 0").select(
        "filename", (F.col("size_bytes") + F.expr("CASE WHEN cast(file_id as bigint) % 6 = 0 THEN 1 ELSE 0 END")).alias("length")
    )
    return manifest.fetch_plan(files, existing).groupBy("status").agg(F.count("*").alias("n"))


@check("csv_required_cols", f"WITH {fx.SLIDES_SQL} SELECT stem AS slice_id, concat(stem, '.jpg') AS filename, CASE WHEN k % 9 <> 0 THEN w END AS tile_x, CAST(CASE WHEN k % 7 <> 0 THEN h / 2.0 END AS DOUBLE) AS tile_white_frac FROM slides")
def csv_required_cols(spark, sf):
    """Written as CSV with the columns in another order, then read through the fixed schema."""
    from tessella.schemas import TILES

    path = new_path(spark, "tiles-csv")
    rows = fx.slides(spark, sf).select(
        F.expr("CASE WHEN k % 7 <> 0 THEN cast(h / 2.0 as double) END").alias("tile_white_frac"), F.col("stem").alias("slice_id"),
        F.expr("CASE WHEN k % 9 <> 0 THEN cast(w as string) ELSE 'null' END").alias("tile_x"), F.concat("stem", F.lit(".jpg")).alias("filename"),
    )
    sinks.write_csv(rows, path, ["slice_id"])
    return tables.read_csv(spark, path, TILES, ["filename", "slice_id"]).select("slice_id", "filename", "tile_x", "tile_white_frac")


@check("list_images", r"""SELECT name, page_id, row_number() OVER (ORDER BY name, page_id) - 1 AS image_index FROM (SELECT page_id, concat(md5(url), CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.html' END) AS name FROM pages) q WHERE page_id % 3 <> 2""")
def list_images(spark, sf):
    names = table(spark, sf, "pages").selectExpr("page_id", "concat(md5(url), CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.html' END) AS name")
    return listings.list_images(names, name="name", ties=["page_id"])


CKPT_SQL = """ckpt AS (SELECT p_partkey, p_partkey // 50 AS run, concat(CASE p_partkey % 4 WHEN 0 THEN concat('epoch-', CAST(p_size AS VARCHAR)) WHEN 1 THEN concat('at-step', CAST(p_partkey AS VARCHAR))
  WHEN 2 THEN CASE WHEN p_partkey % 50 = 2 THEN 'last' ELSE concat('w', p_brand) END ELSE p_brand END, '.safetensors') AS name, (p_partkey * 37) % 1000 AS mtime FROM part)"""
CKPT_KEY = r"""CASE WHEN regexp_matches(name, '^epoch-([0-9]+)\.safetensors$') THEN 0 WHEN regexp_matches(name, '^at-step([0-9]+)\.safetensors$') THEN 1 WHEN name = 'last.safetensors' THEN 2 ELSE 3 END AS rk,
  coalesce(TRY_CAST(regexp_extract(name, '^(?:epoch-|at-step)([0-9]+)\.safetensors$', 1) AS BIGINT), 0) AS num"""


def _checkpoints(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "p_partkey div 50 AS run",
        "concat(CASE p_partkey % 4 WHEN 0 THEN concat('epoch-', p_size) WHEN 1 THEN concat('at-step', p_partkey) WHEN 2 THEN CASE WHEN p_partkey % 50 = 2 THEN 'last' ELSE concat('w', p_brand) END ELSE p_brand END, '.safetensors') AS name",
        "(p_partkey * 37) % 1000 AS mtime",
    )


@check("ckpt_order", f"""WITH {CKPT_SQL}, keyed AS (SELECT *, {CKPT_KEY} FROM ckpt WHERE name <> 'last.safetensors'),
  late AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY run ORDER BY rk DESC, num DESC, CASE WHEN rk = 3 THEN name ELSE '' END DESC, p_partkey DESC) <= 30)
  SELECT run, p_partkey, name, row_number() OVER (PARTITION BY run ORDER BY rk, num, CASE WHEN rk = 3 THEN name ELSE '' END, p_partkey) - 1 AS position FROM late""")
def ckpt_order(spark, sf):
    out = listings.checkpoints(_checkpoints(spark, sf), "run", "name", include_last=False, latest=30, ties=["p_partkey"])
    return out.select("run", "p_partkey", "name", "position")


@check("ckpt_mtime", f"""WITH {CKPT_SQL} SELECT run, name, mtime, row_number() OVER (PARTITION BY run ORDER BY mtime, name) - 1 AS position FROM ckpt c
  WHERE name <> 'last.safetensors' OR NOT EXISTS (SELECT 1 FROM ckpt o WHERE o.run = c.run AND o.name <> 'last.safetensors')""")
def ckpt_mtime(spark, sf):
    return listings.checkpoints_by_time(_checkpoints(spark, sf), "run", "name", "mtime").select("run", "name", "mtime", "position")


@check("ckpt_explicit", f"""WITH {CKPT_SQL}, asked AS (SELECT p_partkey, run, CAST(0 AS INT) AS position, name AS wanted FROM ckpt UNION ALL SELECT p_partkey, run, 1, 'last.safetensors' FROM ckpt UNION ALL SELECT p_partkey, run, 2, 'epoch-7.safetensors' FROM ckpt)
  SELECT p_partkey, position, wanted, EXISTS (SELECT 1 FROM ckpt c WHERE c.run = a.run AND c.name = a.wanted) AS found FROM asked a""")
def ckpt_explicit(spark, sf):
    files = _checkpoints(spark, sf)
    asked = files.select("p_partkey", "run", F.concat("name", F.lit(", ,last.safetensors ,epoch-7.safetensors")).alias("names"))
    out = listings.explicit_checkpoints(asked, files, "run", "names", "name", strict=False)
    return out.select("p_partkey", "position", "wanted", "found")


@check("prompt_labels", r"""SELECT doc_id, CAST(i - 1 AS INT) AS prompt_index, regexp_extract(kept[i], '(?i)(?:diagnosis|tissue\s*pattern):\s*([A-Za-z0-9_]+)', 1) AS label, md5(kept[i]) AS digest
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(text, '. ', '. Diagnosis: '), chr(10), concat(chr(10), '  ', chr(10), '#x', chr(10))), '\r?\n'), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%') AS kept FROM documents) q,
  unnest(range(1, len(kept) + 1)) AS u(i)""")
def prompt_labels(spark, sf):
    text = F.expr(r"replace(replace(text, '. ', '. Diagnosis: '), '\n', '\n  \n#x\n')")
    lines = listings.prompt_labels(table(spark, sf, "documents").select("doc_id", text.alias("t")), "t")
    return lines.select("doc_id", "prompt_index", "label", F.md5("line").alias("digest"))


@check("sink_skip_existing", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders")
def sink_skip_existing(spark, sf):
    path = new_path(spark, "kept")
    orders = table(spark, sf, "orders").select("o_orderkey")
    sinks.append_new(orders.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("old")), path, ["o_orderkey"], buckets=16)
    sinks.append_new(orders.withColumn("origin", F.lit("new")), path, ["o_orderkey"])
    return sinks.read_appended(spark, path)


@check("pair_join", f"""{NAMED}, hist AS (SELECT k, cid, count(*) AS n FROM (SELECT k, CAST(CASE WHEN k % 37 = 0 THEN 0 WHEN (x * y + k) % 97 = 0 THEN -1 WHEN (x // 12 + y // 10 + k) % 4 < k % 4 THEN 0 ELSE 1 + ((x // 8) * 3 + (y // 8) * 5 + k * 7) % 11 END AS INT) AS cid
    FROM slides, unnest(range(0, w)) AS ux(x), unnest(range(0, h)) AS uy(y)) q GROUP BY ALL),
  cls AS (SELECT k, list_sort(list(cid) FILTER (cid >= 0)) AS ids, coalesce(arg_max(cid, n * 100 - cid) FILTER (cid > 0), 0) AS dominant FROM hist GROUP BY k)
  SELECT l.k, l.stem AS slice_id, concat(l.stem, '.jpg') AS filename, concat(l.stem, '.png') AS mask_filename, l.volume_id, l.slice_index, l.group_code, l.coarse_label, array_to_string(ids, ',') AS classes_present, CAST(dominant AS INT) AS dominant_class_id,
    CASE WHEN list_has_any(ids, [9, 10, 11]) THEN 'cancer' ELSE 'non_cancer' END AS mask_label FROM labelled l JOIN masks m USING (stem) JOIN cls ON cls.k = l.k""")
def pair_join(spark, sf):
    classes = roi.image_classes(roi.class_counts(fx.class_blocks(spark, sf)))
    images = fx.slides(spark, sf).select(F.col("k").alias("image_id"), "stem", F.concat(F.lit("/img/"), "stem", F.lit(".jpg")).alias("image_path"))
    masks = fx.masks(spark, sf).select("stem", F.concat(F.lit("/msk/"), "stem", F.lit(".png")).alias("mask_path"))
    return joins.pair_images(images, masks, classes).select(
        F.col("image_id").alias("k"), "slice_id", "filename", "mask_filename", "volume_id", "slice_index", "group_code", "coarse_label",
        F.array_join(F.col("classes_present").cast("array<string>"), ",").alias("classes_present"), "dominant_class_id",
        labels.coarse_by_classes(F.col("classes_present")).alias("mask_label"),
    )


@check("pair_missing", f"WITH {fx.SLIDES_SQL} SELECT k, concat(stem, '.jpg') AS filename FROM slides ANTI JOIN masks USING (stem)")
def pair_missing(spark, sf):
    s = fx.slides(spark, sf).select("k", "stem", F.concat("stem", F.lit(".jpg")).alias("filename"))
    return s.join(fx.masks(spark, sf).select("stem"), "stem", "left_anti").select("k", "filename")


@check("pair_stats", f"WITH {fx.SLIDES_SQL} SELECT (SELECT count(*) FROM slides) AS total_images, (SELECT count(*) FROM masks) AS total_masks, (SELECT count(*) FROM slides SEMI JOIN masks USING (stem)) AS paired_rows, (SELECT count(*) FROM slides ANTI JOIN masks USING (stem)) AS missing_masks")
def pair_stats(spark, sf):
    return metrics.pairing_stats(fx.slides(spark, sf), fx.masks(spark, sf), "stem")


@check("value_counts", f"{NAMED} SELECT coarse_label, count(*) AS n FROM labelled GROUP BY coarse_label")
def value_counts(spark, sf):
    label = labels.coarse_by_group(naming.group_code(F.col("stem")))
    return metrics.value_counts(fx.slides(spark, sf).select(label.alias("coarse_label")), "coarse_label")


@check("coarse_by_classes", f"WITH {fx.PIXELS_SQL} SELECT k, CASE WHEN bool_or(cid IN (9, 10, 11)) THEN 'cancer' ELSE 'non_cancer' END AS coarse_label FROM pixels GROUP BY k")
def coarse_by_classes(spark, sf):
    classes = roi.image_classes(roi.class_counts(fx.class_blocks(spark, sf)))
    return classes.select(F.col("image_id").alias("k"), labels.coarse_by_classes(F.col("classes_present")).alias("coarse_label"))


LISTED_SQL = """listed AS (SELECT concat('m_', stem, '.png') AS name FROM slides WHERE k % 5 = 0 UNION SELECT concat(stem, '.jpg') FROM slides WHERE k % 5 = 1
  UNION SELECT concat(stem, '.png') FROM slides WHERE k % 5 IN (0, 2, 3) UNION SELECT concat(stem, '.jpeg') FROM slides WHERE k % 5 = 3)"""


@check("mask_resolve", f"""WITH {fx.SLIDES_SQL} SELECT k, CASE k % 5 WHEN 0 THEN concat('m_', stem, '.png') WHEN 1 THEN concat(stem, '.jpg') WHEN 2 THEN concat(stem, '.png') WHEN 3 THEN concat(stem, '.png') END AS resolved FROM slides""")
def mask_resolve(spark, sf):
    s = fx.slides(spark, sf)
    listed = s.select(F.explode(F.expr(
        "CASE k % 5 WHEN 0 THEN array(concat('m_', stem, '.png'), concat(stem, '.png')) WHEN 1 THEN array(concat(stem, '.jpg')) WHEN 2 THEN array(concat(stem, '.png')) WHEN 3 THEN array(concat(stem, '.jpeg'), concat(stem, '.png')) ELSE array() END"
    )).alias("name"))
    names = joins.mask_candidates(F.concat(F.lit("m_"), "stem", F.lit(".png")), F.concat("stem", F.lit(".jpg")))
    return joins.first_existing(s, "k", names, listed, "name").select("k", "resolved")


@check("meta_merge", f"""WITH {fx.SLIDES_SQL} SELECT stem AS slice_id, 100 + k AS seed, concat('e', CAST(k AS VARCHAR)) AS note_edit, concat('p', CAST(k AS VARCHAR)) AS note_extract, h - 7 AS bbox_y_max, CASE WHEN k % 2 = 0 THEN 'cancer' ELSE 'non_cancer' END AS coarse_label FROM slides WHERE k % 4 <> 1 AND k % 6 <> 0""")
def meta_merge(spark, sf):
    s = fx.slides(spark, sf)
    edits = s.where("k % 4 <> 1").selectExpr("stem AS slice_id", "100 + k AS seed", "concat('e', k) AS note", "'unset' AS coarse_label")
    patches = s.where("k % 6 <> 0").selectExpr("stem AS slice_id", "h - 7 AS bbox_y_max", "concat('p', k) AS note", "CASE WHEN k % 2 = 0 THEN 'cancer' ELSE 'non_cancer' END AS coarse_label")
    return joins.merge_metadata(edits, patches).select("slice_id", "seed", "note_edit", "note_extract", "bbox_y_max", "coarse_label")


@check("has_mask", f"WITH {fx.SLIDES_SQL} SELECT k FROM slides SEMI JOIN masks USING (stem)")
def has_mask(spark, sf):
    return fx.slides(spark, sf).join(fx.masks(spark, sf).select("stem"), "stem", "left_semi").select("k")


@check("missing_masks", f"WITH {fx.SLIDES_SQL} SELECT (SELECT count(*) FROM slides ANTI JOIN masks USING (stem)) AS n_missing, (SELECT string_agg(stem, ',' ORDER BY stem) FROM (SELECT stem FROM slides ANTI JOIN masks USING (stem) ORDER BY stem LIMIT 8) q) AS examples")
def missing_masks(spark, sf):
    report = joins.missing_report(fx.slides(spark, sf), fx.masks(spark, sf), "stem", "stem")
    return report.select("n_missing", F.array_join("examples", ",").alias("examples"))


CHAIN_SQL = """items AS (SELECT k, concat(CASE k % 4 WHEN 1 THEN 'real_' WHEN 2 THEN 'synth_opmd_' WHEN 3 THEN CASE WHEN k % 8 = 3 THEN 'synth_cancer' ELSE 'synth_unknown_' END ELSE '' END, CASE WHEN k % 8 = 3 THEN '' ELSE CAST(k AS VARCHAR) END) AS stem FROM slides),
  known AS (SELECT CAST(k AS VARCHAR) AS stem, CASE WHEN k % 3 = 0 THEN 'cancer' ELSE 'healthy' END AS token FROM slides WHERE k % 5 <> 0)"""


@check("label_lookup_chain", f"""WITH {fx.SLIDES_SQL}, {CHAIN_SQL} SELECT i.k, i.stem, coalesce(a.token, b.token, nullif(regexp_extract(i.stem, '^synth_(healthy|benign_lesion|opmd|cancer)(?:_|$)', 1), ''), 'benign_lesion') AS token
  FROM items i LEFT JOIN known a ON a.stem = i.stem LEFT JOIN known b ON i.stem LIKE 'real!_%' ESCAPE '!' AND b.stem = substr(i.stem, 6)""")
def label_lookup_chain(spark, sf):
    s = fx.slides(spark, sf)
    items = s.selectExpr(
        "k", "concat(CASE k % 4 WHEN 1 THEN 'real_' WHEN 2 THEN 'synth_opmd_' WHEN 3 THEN CASE WHEN k % 8 = 3 THEN 'synth_cancer' ELSE 'synth_unknown_' END ELSE '' END, CASE WHEN k % 8 = 3 THEN '' ELSE cast(k as string) END) AS stem"
    )
    known = s.where("k % 5 <> 0").selectExpr("cast(k as string) AS stem", "CASE WHEN k % 3 = 0 THEN 'cancer' ELSE 'healthy' END AS token")
    return joins.label_chain(items, known, labels.TOKENS).select("k", "stem", "token")


@check("anchor_link", f"""WITH {fx.SLIDES_SQL} SELECT k, concat('caption ', CAST(k AS VARCHAR)) AS caption, concat(stem, CASE WHEN k % 2 = 0 THEN '.jpg' ELSE '.png' END) AS mask_name FROM slides WHERE k % 7 <> 0 AND k % 13 <> 5""")
def anchor_link(spark, sf):
    s = fx.slides(spark, sf).select("k", "stem")
    captions = s.where("k % 7 <> 0").select("stem", F.concat(F.lit("caption "), "k").alias("caption"))
    masks = fx.masks(spark, sf).select("stem", F.explode(F.expr("CASE WHEN k % 2 = 0 THEN array(concat(stem, '.png'), concat(stem, '.jpg')) ELSE array(concat(stem, '.png')) END")).alias("mask_name"))
    return joins.link_anchors(s, captions, masks).select("k", "caption", "mask_name")


@check("reuse_existing", "SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS reused_existing FROM orders")
def reuse_existing(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return joins.mark_existing(orders, orders.where("o_orderkey % 3 = 0 AND o_orderkey % 2 = 1"), "o_orderkey")


@check("task_grid", f"""{NAMED} SELECT k AS source_index, coarse_label AS source_label, t.label AS target_label, CAST(t.i AS INT) AS target_index, m.model AS model_alias,
  CASE WHEN coarse_label = t.label THEN 'same_class' ELSE 'cross_class' END AS prompt_mode, CAST(42 + CAST(k AS BIGINT) * 1000 + t.i AS BIGINT) AS seed
  FROM labelled, (VALUES (0, 'cancer'), (1, 'non_cancer')) t(i, label), (VALUES ('base'), ('tuned'), ('best')) m(model)""")
def task_grid(spark, sf):
    sources = fx.slides(spark, sf).select(F.col("k").alias("source_index"), labels.coarse_by_group(naming.group_code(F.col("stem"))).alias("source_label"))
    return joins.task_grid(sources, ["cancer", "non_cancer"], ["base", "tuned", "best"])


@check("shared_sources", """SELECT o_orderkey, o_orderpriority, m.model, row_number() OVER (PARTITION BY m.model ORDER BY o_orderkey, o_orderpriority) - 1 AS source_index FROM
  (SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '42', o_orderpriority, o_orderkey)), o_orderkey) <= 200) q, (VALUES ('a'), ('b')) m(model)""")
def shared_sources(spark, sf):
    path = new_path(spark, "sources")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    make = lambda: sampling.stratified_sample(orders, "o_orderpriority", 200, 42, ["o_orderkey"])
    parts = [joins.shared_sources(spark, path, make).withColumn("model", F.lit(m)) for m in ("a", "b")]
    return parts[0].unionByName(parts[1])


@check("materialize_stats", f"""WITH {fx.SLIDES_SQL} SELECT status, count(*) AS n, count(DISTINCT k) AS sources FROM (SELECT k, CASE WHEN k % 13 = 5 THEN 'missing' WHEN (k + i) % 4 = 0 THEN 'skipped' ELSE 'written' END AS status FROM slides, unnest(range(0, 3)) AS u(i)) q GROUP BY status""")
def materialize_stats(spark, sf):
    tiles = fx.slides(spark, sf).select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    existing = tiles.where("(k + i) % 4 = 0")
    return metrics.materialize_stats(tiles, fx.masks(spark, sf).select("k"), existing, "k", ["k", "i"])


HISTORY_SQL = """SELECT CAST(o_orderkey AS INT) AS cycle, CASE WHEN o_orderkey % 2 = 0 THEN concat('c', CAST(o_orderkey AS VARCHAR)) END AS start_checkpoint, round(o_totalprice / 1e6, 6) AS cycle_best_combined_reward,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS pseudo_rows_kept, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS linked_real_anchor_images, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 7 END AS pseudo_dropped_same_prob,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS holdout_summary_json, CASE WHEN o_orderkey % 2 = 0 THEN o_comment_ END AS next_curriculum_mask_dir FROM (SELECT *, concat('/m/', CAST(o_custkey AS VARCHAR)) AS o_comment_ FROM orders) q"""


@check("history_append", HISTORY_SQL)
def history_append(spark, sf):
    from tessella.schemas import HISTORY

    orders = table(spark, sf, "orders").withColumn("cycle", F.col("o_orderkey").cast("int")).withColumn("cycle_best_combined_reward", F.round(F.col("o_totalprice") / 1e6, 6))
    old = orders.where("o_orderkey % 2 = 0").select("cycle", F.concat(F.lit("c"), "o_orderkey").alias("start_checkpoint"), "cycle_best_combined_reward", F.concat(F.lit("/m/"), "o_custkey").alias("next_curriculum_mask_dir"))
    new = orders.where("o_orderkey % 2 = 1").select(
        "cycle", "cycle_best_combined_reward", F.col("o_orderkey").alias("pseudo_rows_kept"), F.col("o_custkey").alias("linked_real_anchor_images"),
        (F.col("o_custkey") % 7).alias("pseudo_dropped_same_prob"), F.col("o_orderpriority").alias("holdout_summary_json"),
    )
    asked = ["cycle", "start_checkpoint", "cycle_best_combined_reward", "pseudo_rows_kept", "linked_real_anchor_images", "pseudo_dropped_same_prob", "holdout_summary_json", "next_curriculum_mask_dir"]
    return sinks.append_history(old, new, HISTORY).select(*asked)
