"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check, table
from tessella.functions import boxes, coerce, labels, naming, prompts, scores, seeds

VOLUME_SQL = """
named AS (SELECT k, stem,
  CASE WHEN regexp_matches(core, '^(.*?)-([0-9]+)$') THEN
    CASE WHEN stem LIKE '%)' AND regexp_extract(core, '^(.*?)-([0-9]+)$', 1) NOT LIKE '%)' THEN concat(regexp_extract(core, '^(.*?)-([0-9]+)$', 1), ')')
         ELSE regexp_extract(core, '^(.*?)-([0-9]+)$', 1) END ELSE stem END AS volume_id,
  CAST(CASE WHEN regexp_matches(core, '^(.*?)-([0-9]+)$') THEN CAST(regexp_extract(core, '^(.*?)-([0-9]+)$', 2) AS INT) ELSE -1 END AS INT) AS slice_index,
  coalesce(nullif(regexp_extract(stem, '\\(([A-Z])[0-9]-[0-9]\\)', 1), ''), 'UNK') AS group_code
  FROM (SELECT *, regexp_replace(stem, '\\)$', '') AS core FROM slides) q),
labelled AS (SELECT *, CASE WHEN group_code IN ('B', 'C', 'D') THEN 'cancer' ELSE 'non_cancer' END AS coarse_label FROM named)
"""
NAMED = f"WITH {fx.SLIDES_SQL}, {VOLUME_SQL}"


@check("parse_volume", f"{NAMED} SELECT k, volume_id, slice_index FROM named")
def parse_volume(spark, sf):
    return fx.slides(spark, sf).select("k", naming.volume_id(F.col("stem")).alias("volume_id"), naming.slice_index(F.col("stem")).alias("slice_index"))


@check("group_code", f"{NAMED} SELECT k, group_code FROM named")
def group_code(spark, sf):
    return fx.slides(spark, sf).select("k", naming.group_code(F.col("stem")).alias("group_code"))


@check("coarse_by_group", f"{NAMED} SELECT k, coarse_label FROM labelled")
def coarse_by_group(spark, sf):
    return fx.slides(spark, sf).select("k", labels.coarse_by_group(naming.group_code(F.col("stem"))).alias("coarse_label"))


@check("binary_target", f"{NAMED} SELECT k, CAST(coarse_label = 'cancer' AS INT) AS y FROM labelled")
def binary_target(spark, sf):
    label = labels.coarse_by_group(naming.group_code(F.col("stem")))
    return fx.slides(spark, sf).select("k", labels.binary_target(label).alias("y"))


@check("class_name", "SELECT p_partkey, CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in labels.CLASS_NAMES.items())
       + " ELSE concat('class_', CAST(p_partkey % 14 AS VARCHAR)) END AS class_name FROM part")
def class_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.class_name((F.col("p_partkey") % 14).cast("int")).alias("class_name"))


@check("path_parts", r"""SELECT page_id, name, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem,
  lower(regexp_replace(name, '^(.+)\.[^.]+$', '\1')) AS stem_key FROM (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name FROM pages) q""")
def path_parts(spark, sf):
    name = naming.path_name(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", name.alias("name"), naming.name_suffix(name).alias("suffix"), naming.name_stem(name).alias("stem"), naming.stem_key(F.col("url")).alias("stem_key")
    )


SPACE_SQL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NORMAL = rf"""regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(text, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+\z', '', 'g')), '[^\x00-\x7F]', '', 'g')), '[\t-\r\x1c-\x20]+', ' ', 'g')"""


@check("normalise_text", f"SELECT doc_id, md5(n) AS digest, length(n) AS n_chars FROM (SELECT doc_id, {NORMAL} AS n FROM documents) q")
def normalise_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", labels.normalise_category(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("bigint").alias("n_chars"))


@check("label_token", """SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'cancer' WHEN 'household' THEN 'household' WHEN 'machinery' THEN 'machinery' ELSE 'benign_lesion' END AS token FROM customer""")
def label_token(spark, sf):
    category = labels.normalise_category(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(
        "c_custkey", labels.label_token(category, {"building": "cancer"}, ["household", "machinery"]).alias("token")
    )


@check("safe_name", r"""SELECT doc_id, md5(coalesce(nullif(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item')) AS digest FROM documents""")
def safe_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(naming.safe_name(F.col("text"))).alias("digest"))


@check("caption_render", """SELECT c_custkey, concat('clinical photo, diagnosis: ', t, CASE t WHEN 'building' THEN ', dense morphology' WHEN 'household' THEN ', even surface' ELSE '' END) AS caption,
  concat('[', CASE t WHEN 'building' THEN 'dense morphology' WHEN 'household' THEN 'even surface' ELSE '' END, '] ', t) AS plain FROM (SELECT c_custkey, lower(c_mktsegment) AS t FROM customer) q""")
def caption_render(spark, sf):
    token = F.lower("c_mktsegment")
    texts = {"building": " dense morphology ", "household": "even surface", "machinery": "  "}
    return table(spark, sf, "customer").select(
        "c_custkey",
        prompts.render("clinical photo, diagnosis: {token}{descriptor_suffix} ", token, texts).alias("caption"),
        prompts.render("[{descriptor}] {token}{descriptor_suffix}", token, texts, use_descriptors=False).alias("plain"),
    )


@check("caption_token", rf"""SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?i)(?:diagnosis|tissue\s*pattern):\s*([A-Za-z0-9_]+)', 1), ''),
  nullif(regexp_extract(t, '([^{SPACE_SQL}]+)[{SPACE_SQL}]*\z', 1), ''), 'benign_lesion') AS token
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, ' Diagnosis: tok_', CAST(doc_id % 9 AS VARCHAR), ' end') WHEN 1 THEN concat('tissue pattern:x', CAST(doc_id AS VARCHAR), '. ', text) ELSE text END AS t FROM documents) q""")
def caption_token(spark, sf):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(text, ' Diagnosis: tok_', doc_id % 9, ' end') WHEN 1 THEN concat('tissue pattern:x', doc_id, '. ', text) ELSE text END")
    return table(spark, sf, "documents").select("doc_id", prompts.caption_token(text).alias("token"))


NAME_SQL = "concat(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), '_', CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE CAST(o_custkey % 7 AS VARCHAR) END, '_', CAST(o_orderkey AS VARCHAR), '.png')"


@check("expected_label", f"""SELECT o_orderkey, i AS prompt_index, CASE i WHEN 0 THEN 'healthy' WHEN 1 THEN 'benign_lesion' WHEN 2 THEN 'opmd' WHEN 3 THEN 'cancer' END AS expected_label
  FROM (SELECT o_orderkey, TRY_CAST(split_part({NAME_SQL}, '_', 2) AS INT) AS i FROM orders) q""")
def expected_label(spark, sf):
    from tessella.operators.joins import join_expected

    names = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "concat(lpad(cast(o_orderkey as string), 6, '0'), '_', CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE cast(o_custkey % 7 as string) END, '_', o_orderkey, '.png') AS name",
    )
    expected = spark.createDataFrame(list(enumerate(labels.TOKENS)), "prompt_index int, expected_label string")
    return join_expected(names, expected).select("o_orderkey", "prompt_index", "expected_label")


RAW = "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN 'nan' WHEN 3 THEN '12.7' WHEN 4 THEN 'x1' WHEN 5 THEN NULL WHEN 6 THEN '-3.9' ELSE concat(CAST(event_id AS {s}), '.5') END"


@check("coerce_int", f"SELECT event_id, CASE event_id % 8 WHEN 3 THEN 12 WHEN 6 THEN -3 WHEN 7 THEN CAST(event_id AS INT) END AS v, coalesce(CASE event_id % 8 WHEN 3 THEN 12 WHEN 6 THEN -3 WHEN 7 THEN CAST(event_id AS INT) END, 9) AS d FROM events")
def coerce_int(spark, sf):
    raw = F.expr(RAW.format(s="string"))
    return table(spark, sf, "events").select("event_id", coerce.to_int(raw).alias("v"), coerce.to_int(raw, 9).alias("d"))


@check("coerce_float", f"""SELECT event_id, f AS v, coalesce(f, 0.25) AS d FROM (SELECT event_id, CASE WHEN raw IN ('nan', '') THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS f FROM (SELECT event_id, {RAW.format(s='VARCHAR')} AS raw FROM events) p) q""")
def coerce_float(spark, sf):
    raw = F.expr(RAW.format(s="string"))
    return table(spark, sf, "events").select("event_id", coerce.to_float(raw).alias("v"), coerce.to_float(raw, 0.25).alias("d"))


@check("json_map", """SELECT event_id, k, CAST(k AS VARCHAR) AS t, greatest(0, CAST(k AS INT) - 50) AS n FROM (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS kd, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events) q""")
def json_map(spark, sf):
    props = F.col("props")
    shifted = F.to_json(F.transform_values(coerce.float_map(props), lambda _, v: v - 50))
    return table(spark, sf, "events").select(
        "event_id", coerce.float_map(props)["k"].cast("bigint").alias("k"), coerce.text_map(props)["k"].alias("t"), coerce.repeat_map(shifted)["k"].alias("n")
    )


@check("id_list", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN '' WHEN l_suppkey = l_linenumber THEN CAST(l_linenumber AS VARCHAR)
  WHEN l_suppkey < l_linenumber THEN concat(l_suppkey, ',', l_linenumber) ELSE concat(l_linenumber, ',', l_suppkey) END AS ids FROM lineitem""")
def id_list(spark, sf):
    text = F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE concat(l_linenumber, ', ', l_suppkey, ', ,', l_linenumber) END")
    ids = F.array_join(F.array_sort(coerce.id_list(text)).cast("array<string>"), ",")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ids.alias("ids"))


BOX_SQL = """rawbox AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_partkey % 400 AS INT) END AS x, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_suppkey % 300 AS INT) END AS y,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE 64 END AS size, CASE l_linenumber WHEN 4 THEN 0 WHEN 5 THEN -5 WHEN 6 THEN NULL ELSE CAST(l_orderkey % 90 AS INT) END AS w,
  CASE l_linenumber WHEN 7 THEN 0 ELSE CAST(l_orderkey % 50 AS INT) END AS h FROM lineitem)"""
CROP_SQL = """crop AS (SELECT o, n, p, s, CASE WHEN ok THEN x END AS x0, CASE WHEN ok THEN y END AS y0, CASE WHEN ok THEN x + w END AS x1, CASE WHEN ok THEN y + h END AS y1
  FROM (SELECT *, coalesce(x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0, false) AS ok FROM (SELECT o, n, p, s, x, y, coalesce(nullif(w, 0), size) AS w, coalesce(nullif(h, 0), size) AS h FROM rawbox) a) b)"""


def _raw_boxes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s",
        "CASE WHEN l_linenumber = 1 THEN 'null' ELSE cast(l_partkey % 400 AS string) END AS x",
        "CASE WHEN l_linenumber = 2 THEN '' ELSE concat(l_suppkey % 300, '.0') END AS y",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE '64' END AS size",
        "CASE l_linenumber WHEN 4 THEN '0' WHEN 5 THEN '-5' WHEN 6 THEN 'nan' ELSE cast(l_orderkey % 90 AS string) END AS w",
        "CASE l_linenumber WHEN 7 THEN '0' ELSE cast(l_orderkey % 50 AS string) END AS h",
    )


@check("crop_box", f"WITH {BOX_SQL}, {CROP_SQL} SELECT * FROM crop")
def crop_box(spark, sf):
    box = boxes.crop_box(*[F.col(c) for c in ("x", "y", "size", "w", "h")])
    return _raw_boxes(spark, sf).withColumn("box", box).select("o", "n", "p", "s", "box.x0", "box.y0", "box.x1", "box.y1")


@check("clamp_box", f"""WITH {BOX_SQL}, {CROP_SQL} SELECT o, n, p, s, x0, y0, CASE WHEN x0 IS NOT NULL THEN greatest(x0 + 1, least(x1, 320)) END AS x1, CASE WHEN y0 IS NOT NULL THEN greatest(y0 + 1, least(y1, 240)) END AS y1
  FROM (SELECT o, n, p, s, x1, y1, CASE WHEN x0 IS NOT NULL THEN greatest(0, least(x0, 319)) END AS x0, CASE WHEN y0 IS NOT NULL THEN greatest(0, least(y0, 239)) END AS y0 FROM crop) q""")
def clamp_box(spark, sf):
    box = boxes.clamp_box(boxes.crop_box(*[F.col(c) for c in ("x", "y", "size", "w", "h")]), F.lit(320), F.lit(240))
    return _raw_boxes(spark, sf).withColumn("box", box).select("o", "n", "p", "s", "box.x0", "box.y0", "box.x1", "box.y1")


@check("task_seed", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 42 + l_suppkey * 1000 + l_linenumber AS task, 42 + l_linenumber * 10000 + l_suppkey AS class, 7 + l_partkey AS row_seed, 222 + l_partkey * 10007 AS image, 5 + l_linenumber * 100 + l_suppkey AS prompt FROM lineitem")
def task_seed(spark, sf):
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seeds.task_seed(42, s, n).alias("task"), seeds.class_seed(42, n, s).alias("class"),
        seeds.row_seed(7, p).alias("row_seed"), seeds.image_seed(222, p).alias("image"), seeds.prompt_seed("per_class", 5, n, s).alias("prompt"),
    )


@check("name_aliases", f"""WITH {fx.SLIDES_SQL} SELECT k, concat(stem, '.jpg') AS name FROM slides UNION ALL SELECT k, concat(stem, '.png') FROM slides WHERE k % 5 <> 0 AND k % 3 <> 0""")
def name_aliases(spark, sf):
    mask = F.expr("CASE WHEN k % 5 = 0 THEN concat(stem, '.jpg') WHEN k % 3 = 0 THEN '  ' ELSE concat(' ', stem, '.png ') END")
    names = naming.output_names(F.concat("stem", F.lit(".jpg")), [mask, F.lit(None).cast("string"), mask])
    return fx.slides(spark, sf).select("k", F.explode(names).alias("name"))


@check("normalise_mode", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'text2image' WHEN 1 THEN 'text2image' WHEN 2 THEN 'inpaint' WHEN 3 THEN 'inpaint' WHEN 4 THEN 'text2image' END AS mode FROM customer")
def normalise_mode(spark, sf):
    raw = F.expr("CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' TXT2-img' WHEN 2 THEN 'In_Paint' WHEN 3 THEN 'inpainting' WHEN 4 THEN 'text-2-image' ELSE lower(c_mktsegment) END")
    return table(spark, sf, "customer").select("c_custkey", labels.normalise_mode(raw, strict=False).alias("mode"))


@check("task_params", """SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AS x, CAST(CASE WHEN s = t THEN 0.35 WHEN t = '2-HIGH' THEN 0.7 ELSE 0.55 END AS DOUBLE) AS strength, CAST(CASE WHEN s = t THEN 0.0 WHEN t = '5-LOW' THEN 4.0 ELSE 2.0 END AS DOUBLE) AS dilate
  FROM (SELECT *, o_orderpriority AS t, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '3-MEDIUM' END AS s FROM orders) q""")
def task_params(spark, sf):
    source, target = F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '3-MEDIUM' END"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.expr("o_orderstatus = 'F' AND o_orderpriority LIKE '1%'").alias("x"),
        scores.task_parameter(source, target, 0.35, 0.55, {"2-HIGH": 0.7}).alias("strength"),
        scores.task_parameter(source, target, 0.0, 2.0, {"5-LOW": 4.0}).alias("dilate"),
    )


@check("prompt_grid", """SELECT token, CAST(i AS INT) AS prompt_index, concat(CASE WHEN token = 'building' THEN concat('own ', token) WHEN i % 2 = 0 THEN concat('photo of ', token) ELSE concat('scan, ', token) END, ' --n blurry --w 64 --d ', CAST(100 + token_index * 100 + i AS VARCHAR)) AS line
  FROM (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_index FROM (SELECT DISTINCT lower(c_mktsegment) AS token FROM customer) a) b, unnest(range(0, 3)) AS u(i) WHERE token <> 'building' OR i = 0""")
def prompt_grid(spark, sf):
    from tessella.operators.metrics import label_vocabulary

    vocabulary = label_vocabulary([table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("label"))], "label")
    filled = vocabulary.select(
        F.col("label").alias("token"), "label_index",
        F.posexplode(prompts.templates_for(F.col("label"), {"building": ["own {token}"]}, ["photo of {token}", "scan, {token}"], 3)).alias("prompt_index", "template"),
    )
    seed = seeds.prompt_seed("per_class", 100, F.col("label_index"), F.col("prompt_index"))
    line = prompts.prompt_line(prompts.render(F.col("template"), F.col("token"), {}), ["--n blurry", "--w 64"], seed)
    return filled.select("token", "prompt_index", line.alias("line"))


@check("source_key", rf"""WITH {fx.SLIDES_SQL} SELECT k, concat(stem, '.jpg') AS mask_name, concat(CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END, '_', regexp_replace(regexp_replace(stem, '[^\p{{L}}\p{{N}}_-]', '_', 'g'), '^_+|_+$', '', 'g')) AS source_key FROM slides""")
def source_key(spark, sf):
    name = naming.mask_name(F.expr("CASE WHEN k % 2 = 0 THEN ' ' ELSE concat(stem, '.jpg') END"), F.expr("concat('/data/images/', stem, '.jpg')"))
    return fx.slides(spark, sf).select("k", name.alias("mask_name"), naming.source_key(F.col("k"), name).alias("source_key"))


@check("model_specs", """SELECT p_partkey, alias, path, CASE WHEN alias IS NULL OR path IS NULL THEN 'invalid' WHEN count(*) OVER (PARTITION BY alias) > 1 THEN 'duplicate' ELSE 'ok' END AS status
  FROM (SELECT p_partkey, CASE WHEN p_size >= 5 THEN concat(p_brand, '-', CAST(p_partkey // 3 AS VARCHAR)) END AS alias, CASE WHEN p_size >= 5 THEN concat('/m/a=', CAST(p_size AS VARCHAR)) WHEN p_size < 3 THEN '/m/x' END AS path FROM part) q""")
def model_specs(spark, sf):
    from tessella.operators.joins import resolve_models

    spec = F.expr("CASE WHEN p_size < 3 THEN ' =/m/x' WHEN p_size < 5 THEN 'noequals' ELSE concat(' ', p_brand, '-', p_partkey div 3, ' = /m/a=', p_size) END")
    return resolve_models(table(spark, sf, "part").select("p_partkey", spec.alias("spec"))).select("p_partkey", "alias", "path", "status")


_RAW = ["Neoplasias malignas", " Doenças  potencialmente malignas", "Doenças infecciosas", "LESÕES inflamatórias reativas", "Malignant", "Outras", "benign lesion", "non cancer", "unheard of", "Healthy "]
_TOKEN = ["cancer", "opmd", "benign_lesion", "benign_lesion", "cancer", "benign_lesion", "benign_lesion", "non_cancer", "benign_lesion", "healthy"]


@check("label_token_table", "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOKEN)) + " END AS token FROM documents")
def label_token_table(spark, sf):
    """The shipped category table, for spellings as they come."""
    raw = F.element_at(F.array(*[F.lit(r) for r in _RAW]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", labels.label_token(labels.normalise_category(raw)).alias("token"))
