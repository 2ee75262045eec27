"""The reward loop: fold, curriculum, anchors, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.registry import check, table
from tessella.checks.scalars import NAMED
from tessella.checks.scoring import SCORED_SQL, SUMMARY_SQL, scored
from tessella.functions import labels, naming
from tessella.operators import curriculum
from tessella.operators.sampling import with_position

RULES = curriculum.Rules(cross_repeat=2, same_repeat=1, min_cross_margin=-0.2, min_cross_prob=0.15, min_same_prob=0.2, target_repeat={"cancer": 3, "opmd": 0})
JUDGED_SQL = f"""{SCORED_SQL}, judged AS (SELECT *, CASE WHEN prompt_mode = 'cross_class' THEN CASE WHEN target_label = 'cancer' THEN 3 ELSE 2 END ELSE 1 END AS repeat_,
  CASE WHEN prompt_mode = 'cross_class' AND target_source_prob_margin < -0.2 THEN 'dropped_cross_margin' WHEN prompt_mode = 'cross_class' AND target_prob < 0.15 THEN 'dropped_cross_prob' WHEN prompt_mode = 'same_class' AND target_prob < 0.2 THEN 'dropped_same_prob' ELSE 'kept' END AS status FROM scored),
copies AS (SELECT model_alias, concat(prompt_mode, '_', 'src_', CAST(vec_id AS VARCHAR), '__to__', target_label, '__r', lpad(CAST(u.c AS VARCHAR), 2, '0')) AS stem FROM judged, unnest(range(1, repeat_ + 1)) AS u(c) WHERE status = 'kept')"""


def _scored(spark, sf):
    return scored(spark, sf).withColumn("source_key", F.concat(F.lit("src_"), F.col("vec_id").cast("string")))


@check("curriculum_rows", f"WITH {JUDGED_SQL} SELECT model_alias, stem FROM copies")
def curriculum_rows(spark, sf):
    return curriculum.curriculum_rows(_scored(spark, sf), RULES).select("model_alias", "stem")


@check("curriculum_stats", f"""WITH {JUDGED_SQL} SELECT CAST(sum(repeat_) FILTER (status = 'kept') AS BIGINT) AS pseudo_rows_kept, count(*) FILTER (status = 'kept' AND prompt_mode = 'cross_class') AS pseudo_cross_rows, count(*) FILTER (status = 'kept' AND prompt_mode = 'same_class') AS pseudo_same_rows,
  count(*) FILTER (status = 'dropped_cross_margin') AS pseudo_dropped_cross_margin, count(*) FILTER (status = 'dropped_cross_prob') AS pseudo_dropped_cross_prob, count(*) FILTER (status = 'dropped_same_prob') AS pseudo_dropped_same_prob FROM judged""")
def curriculum_stats(spark, sf):
    return curriculum.curriculum_stats(curriculum.judge_rows(_scored(spark, sf), RULES))


ANCHOR_SQL = f"""{NAMED}, ranked AS (SELECT *, concat('/img/', stem, '.jpg') AS image_path, row_number() OVER (PARTITION BY coarse_label ORDER BY md5(concat_ws('|', '9', coarse_label, concat('/img/', stem, '.jpg'))), stem) - 1 AS rk FROM labelled),
anchors AS (SELECT r.k, r.coarse_label, r.image_path, row_number() OVER (ORDER BY r.coarse_label, rk) - 1 AS anchor_index, r.stem, CASE WHEN r.k % 11 = 0 THEN 'missing_image' WHEN m.k IS NULL THEN 'missing_mask' ELSE 'kept' END AS status FROM ranked r LEFT JOIN masks m ON m.k = r.k WHERE rk < 300),
named_anchors AS (SELECT *, concat('real_', lpad(CAST(anchor_index AS VARCHAR), 6, '0'), '_', regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g')) AS name, concat('tissue photo, diagnosis: ', coarse_label, CASE WHEN coarse_label = 'cancer' THEN ', dense growth' ELSE '' END) AS caption FROM anchors)"""


def _anchors(spark, sf):
    s = fx.slides(spark, sf).select("k", "stem", labels.coarse_by_group(naming.group_code(F.col("stem"))).alias("coarse_label"), F.concat(F.lit("/img/"), "stem", F.lit(".jpg")).alias("image_path"), F.lit(" ").alias("filename"))
    images = s.where("k % 11 <> 0").select("image_path")
    masks = fx.masks(spark, sf).select(F.concat("stem", F.lit(".jpg")).alias("mask_name"))
    return curriculum.real_anchors(s, "coarse_label", 300, 9, images, masks, "tissue photo, diagnosis: {token}{descriptor_suffix}", {"cancer": "dense growth"}, ["cancer", "non_cancer"], True)


@check("real_anchor", f"{ANCHOR_SQL} SELECT k, anchor_index, status, name AS stem, caption FROM named_anchors")
def real_anchor(spark, sf):
    return _anchors(spark, sf).select("k", "anchor_index", "status", F.col("stem"), "caption")


@check("curriculum_next", f"{ANCHOR_SQL}, {JUDGED_SQL} SELECT name AS stem, 'real' AS origin, caption, NULL AS model_alias FROM named_anchors WHERE status = 'kept' UNION ALL SELECT stem, 'pseudo', NULL, model_alias FROM copies")
def curriculum_next(spark, sf):
    """Next training set: kept anchors and accepted rows."""
    real = _anchors(spark, sf).where("status = 'kept'").select("stem", F.lit("real").alias("origin"), "caption")
    pseudo = curriculum.curriculum_rows(_scored(spark, sf), RULES).select("stem", F.lit("pseudo").alias("origin"), "model_alias")
    return real.unionByName(pseudo, allowMissingColumns=True)


@check("reward_fold", """WITH RECURSIVE hist AS (SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS cycle, o_totalprice / 1e6 AS score, concat('c', CAST(o_orderkey AS VARCHAR)) AS checkpoint FROM orders),
  fold AS (SELECT h.run, h.cycle, h.score, h.checkpoint, true AS improved, h.score AS best, h.checkpoint AS best_ckpt, 0 AS idle, false AS reverted, h.checkpoint AS next_start FROM hist h WHERE cycle = 1
  UNION ALL SELECT run, cycle, score, checkpoint, imp, nb, nc, ni, score + 0.01::DOUBLE < nb, CASE WHEN score + 0.01::DOUBLE < nb THEN nc ELSE checkpoint END FROM (SELECT h.run, h.cycle, h.score, h.checkpoint, h.score > f.best + 0.01::DOUBLE AS imp, CASE WHEN h.score > f.best + 0.01::DOUBLE THEN h.score ELSE f.best END AS nb,
    CASE WHEN h.score > f.best + 0.01::DOUBLE THEN h.checkpoint ELSE f.best_ckpt END AS nc, CASE WHEN h.score > f.best + 0.01::DOUBLE THEN 0 ELSE f.idle + 1 END AS ni FROM fold f JOIN hist h ON h.run = f.run AND h.cycle = f.cycle + 1 WHERE f.idle < 3) q)
  SELECT run, cycle, improved AS improved_global_best, best AS global_best, best_ckpt AS global_best_checkpoint, idle AS no_improve, reverted, next_start AS next_start_checkpoint FROM fold""")
def reward_fold(spark, sf):
    numbered = with_position(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "cycle", 1, ["o_custkey"])
    history = numbered.select(
        F.col("o_custkey").alias("run"), F.col("cycle").cast("int").alias("cycle"), (F.col("o_totalprice") / 1e6).alias("score"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("checkpoint")
    )
    folded = curriculum.reward_fold(history, 0.01, 3, chunk=8)
    return folded.drop("score", "checkpoint", "global_best_cycle")


@check("quarantine_split", """WITH d AS (SELECT o_orderkey AS k, concat('img', CAST(o_custkey % 50 AS VARCHAR), '.png') AS name, o_orderstatus = 'P' AS bad FROM orders)
  SELECT k, 'clean' AS side, name AS final FROM d WHERE NOT bad UNION ALL SELECT k, 'quarantine', CASE WHEN i = 0 THEN name ELSE replace(name, '.png', concat('__', CAST(i AS VARCHAR), '.png')) END FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS i FROM d WHERE bad) q""")
def quarantine_split(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("concat('img', o_custkey % 50, '.png')").alias("name"), "o_orderstatus")
    clean, bad = curriculum.quarantine(d, d.where("o_orderstatus = 'P'"), "k", "name")
    return clean.select("k", F.lit("clean").alias("side"), F.col("name").alias("final")).unionByName(
        bad.select("k", F.lit("quarantine").alias("side"), F.col("quarantine_name").alias("final"))
    )


@check("reward_fold_gaps", """WITH RECURSIVE hist AS (SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS cycle, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN -2 ELSE o_totalprice / 1e6 END AS score, o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AS odd, concat('c', CAST(o_orderkey AS VARCHAR)) AS checkpoint FROM orders),
  fold AS (SELECT DISTINCT run, 0 AS cycle, -1.0::DOUBLE AS best, CAST(NULL AS VARCHAR) AS best_ckpt, 0 AS idle, false AS improved, false AS reverted, CAST(NULL AS VARCHAR) AS next_start FROM hist
  UNION ALL SELECT run, cycle, nb, nc, ni, imp, back, CASE WHEN back THEN nc ELSE checkpoint END FROM (SELECT *, NOT odd AND nc IS NOT NULL AND score + 0.01::DOUBLE < nb AS back FROM (SELECT h.run, h.cycle, h.score, h.odd, h.checkpoint, NOT odd AND h.score > f.best + 0.01::DOUBLE AS imp,
    CASE WHEN NOT odd AND h.score > f.best + 0.01::DOUBLE THEN h.score ELSE f.best END AS nb, CASE WHEN NOT odd AND h.score > f.best + 0.01::DOUBLE THEN h.checkpoint ELSE f.best_ckpt END AS nc, CASE WHEN NOT odd AND h.score > f.best + 0.01::DOUBLE THEN 0 ELSE f.idle + 1 END AS ni FROM fold f JOIN hist h ON h.run = f.run AND h.cycle = f.cycle + 1) q) r)
  SELECT run, cycle, improved AS improved_global_best, best AS global_best, best_ckpt AS global_best_checkpoint, idle AS no_improve, reverted, next_start AS next_start_checkpoint FROM fold WHERE cycle > 0""")
def reward_fold_gaps(spark, sf):
    """Scores that are missing (zero) or not a number (never an improvement, never a drop)."""
    numbered = with_position(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], "cycle", 1, ["o_custkey"])
    score = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1e6)
    history = numbered.select(F.col("o_custkey").alias("run"), F.col("cycle").cast("int").alias("cycle"), score.alias("score"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("checkpoint"))
    return curriculum.reward_fold(history, 0.01, 0, chunk=8).drop("score", "checkpoint", "global_best_cycle")


@check("quarantine_null", """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 50 <> 7 THEN concat('img', CAST(o_custkey % 50 AS VARCHAR), '.png') END AS name FROM orders WHERE o_orderstatus = 'P')
  SELECT k, CASE WHEN i = 0 THEN name ELSE replace(name, '.png', concat('__', CAST(i AS VARCHAR), '.png')) END AS final FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS i FROM d) q""")
def quarantine_null(spark, sf):
    """Items without a name are set apart as well, and stay nameless."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_custkey % 50 <> 7 THEN concat('img', o_custkey % 50, '.png') END").alias("name"), "o_orderstatus")
    _, bad = curriculum.quarantine(d, d.where("o_orderstatus = 'P'"), "k", "name")
    return bad.select("k", F.col("quarantine_name").alias("final"))


def _reward_sql(src: str) -> str:
    summary = SUMMARY_SQL.format(by="cycle, checkpoint", src=src).replace("summary AS", f"{src}_summary AS", 1)
    pick = lambda mode, col, default: f"coalesce(max({col}) FILTER (prompt_mode = '{mode}'), {default})"
    return f"""{summary}, {src}_reward AS (SELECT cycle, checkpoint, {pick('same_class', 'top1', 0)} AS st, {pick('cross_class', 'top1', 0)} AS ct, {pick('same_class', 'target_prob_mean', 0)} AS sp, {pick('cross_class', 'target_source_prob_margin_mean', -1)} AS cm,
  {pick('cross_class', 'target_source_prob_margin_score', 0)} AS cs FROM {src}_summary GROUP BY ALL)"""


@check("holdout_score", f"""WITH {SCORED_SQL}, cand AS (SELECT *, CAST(vec_id % 3 + 1 AS INT) AS cycle, model_alias AS checkpoint FROM scored), sel AS (SELECT * FROM cand WHERE vec_id % 10 < 7), held AS (SELECT * FROM cand WHERE vec_id % 10 >= 7), {_reward_sql('sel')}, {_reward_sql('held')},
  best AS (SELECT cycle, checkpoint FROM sel_reward QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY 0.5::DOUBLE * sp + 0.5::DOUBLE * cs DESC, cs DESC, ct DESC, sp DESC, st DESC) = 1)
  SELECT cycle, checkpoint, round(0.5::DOUBLE * sp + 0.5::DOUBLE * cs, 5) AS holdout_combined_reward, round(cs, 5) AS holdout_cross_class_margin_score, round(cm, 5) AS holdout_cross_class_target_prob_margin_mean, round(ct, 5) AS holdout_cross_class_target_top1,
    round(sp, 5) AS holdout_same_class_target_prob_mean, round(st, 5) AS holdout_same_class_target_top1 FROM best JOIN held_reward USING (cycle, checkpoint)""")
def holdout_score(spark, sf):
    """The best checkpoint of each cycle, chosen on one part of the rows and scored on the other."""
    from tessella.plans import reward_loop

    position = F.expr("CASE model_alias WHEN 'base' THEN 0L WHEN 'tuned' THEN 1L ELSE 2L END")
    rows = scored(spark, sf).select("*", F.lit("run").alias("run"), (F.col("vec_id") % 3 + 1).cast("int").alias("cycle"), F.col("model_alias").alias("checkpoint"), position.alias("position"))
    history = reward_loop.loop_history(reward_loop.rank_checkpoints(rows.where("vec_id % 10 < 7")), 0.001)
    held = reward_loop.score_holdout(history, rows.where("vec_id % 10 >= 7"))
    return held.select("cycle", "checkpoint", *[F.round(c, 5).alias(c) for c in held.columns if c.startswith("holdout_")])
