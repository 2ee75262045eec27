"""Scoring, metrics, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks.registry import check, table
from tessella.functions import prompts, scores
from tessella.functions.labels import TOKENS
from tessella.operators import joins, metrics, ranking, seams

CLASSES = sorted(TOKENS)
MODELS = ["base", "tuned", "best"]

_LABEL = "CASE label % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOKENS)) + " END"
_PICK = "CASE {c} " + " ".join(f"WHEN '{c}' THEN p{i}" for i, c in enumerate(CLASSES)) + " END"
SCORED_SQL = f"""
logits AS (SELECT vec_id, {_LABEL} AS source_label, m.i AS m, CASE m.i WHEN 0 THEN 'base' WHEN 1 THEN 'tuned' ELSE 'best' END AS model_alias,
  {", ".join(f"2 * list_sum(list_transform(range(0, len(embedding) // 4), lambda x: embedding[4 * x + {j + 1}]::DOUBLE * ((m.i + 1) * (x + 1) % 7 - 3))) AS l{j}" for j in range(4))} FROM embeddings, unnest(range(0, 3)) AS m(i)),
probs AS (SELECT vec_id, source_label, model_alias, e0 / s AS p0, e1 / s AS p1, e2 / s AS p2, e3 / s AS p3 FROM (SELECT *, e0 + e1 + e2 + e3 AS s FROM (
  SELECT *, exp(l0 - greatest(l0, l1, l2, l3)) AS e0, exp(l1 - greatest(l0, l1, l2, l3)) AS e1, exp(l2 - greatest(l0, l1, l2, l3)) AS e2, exp(l3 - greatest(l0, l1, l2, l3)) AS e3 FROM logits) a) b),
predicted AS (SELECT *, greatest(p0, p1, p2, p3) AS confidence, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN '{CLASSES[0]}' WHEN p1 THEN '{CLASSES[1]}' WHEN p2 THEN '{CLASSES[2]}' ELSE '{CLASSES[3]}' END AS pred_label FROM probs),
scored AS (SELECT vec_id, model_alias, source_label, t.t AS target_label, t.i AS target_index, CASE WHEN source_label = t.t THEN 'same_class' ELSE 'cross_class' END AS prompt_mode, pred_label, round(confidence, 6) AS confidence,
  round({_PICK.format(c='t.t')}, 6) AS target_prob, round({_PICK.format(c='source_label')}, 6) AS source_prob,
  CASE WHEN source_label <> t.t THEN round({_PICK.format(c='t.t')} - {_PICK.format(c='source_label')}, 6) END AS target_source_prob_margin, pred_label = t.t AS target_correct
  FROM predicted, (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TOKENS))}) t(i, t))
"""


def _embeddings(spark, sf):
    label = F.expr(_LABEL)
    return table(spark, sf, "embeddings").select("vec_id", label.alias("source_label"), F.col("embedding").cast("array<double>").alias("v"))


def _logits(spark, sf):
    """Four logits per vector and model; every element of a vector enters one of them, with a weight of the model's own."""
    models = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("model_alias")) for i, n in enumerate(MODELS)])
    rows = _embeddings(spark, sf).withColumn("_m", F.explode(models)).select("*", "_m.*").drop("_m")
    logit = "aggregate(sequence(0, size(v) div 4 - 1), 0D, (a, x) -> a + v[4 * x + j] * ((m + 1) * (x + 1) % 7 - 3)) * 2"
    return rows.withColumn("logits", F.expr(f"transform(sequence(0, 3), j -> {logit})")).drop("v", "m")


def predictions(spark, sf):
    rows = _logits(spark, sf).withColumn("probs", scores.softmax(F.col("logits")))
    return rows.select("vec_id", "source_label", "model_alias", "probs", scores.predicted(F.col("probs"), CLASSES).alias("pred_label"), F.array_max("probs").alias("confidence"))


def scored(spark, sf):
    """Benchmark rows: every vector x target x model."""
    target = F.explode(F.array(*[F.struct(F.lit(i).alias("target_index"), F.lit(t).alias("target_label")) for i, t in enumerate(TOKENS)]))
    rows = predictions(spark, sf).withColumn("_t", target).select("*", "_t.*").drop("_t")
    tp = scores.probability_of(F.col("probs"), F.col("target_label"), CLASSES)
    sp = scores.probability_of(F.col("probs"), F.col("source_label"), CLASSES)
    return rows.select(
        "vec_id", "model_alias", "source_label", "target_label", "target_index", scores.prompt_mode(F.col("source_label"), F.col("target_label")).alias("prompt_mode"),
        "pred_label", F.round("confidence", 6).alias("confidence"), F.round(tp, 6).alias("target_prob"), F.round(sp, 6).alias("source_prob"),
        F.round(scores.margin(F.col("source_label"), F.col("target_label"), sp, tp), 6).alias("target_source_prob_margin"),
        (F.col("pred_label") == F.col("target_label")).alias("target_correct"),
    )


def rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@check("softmax_pred", f"WITH {SCORED_SQL} SELECT vec_id, model_alias, pred_label, round(confidence, 6) AS confidence, round(p{CLASSES.index('cancer')}, 6) AS p_cancer FROM predicted")
def softmax_pred(spark, sf):
    p = predictions(spark, sf)
    cancer = scores.probability_of(F.col("probs"), F.lit("cancer"), CLASSES)
    return p.select("vec_id", "model_alias", "pred_label", F.round("confidence", 6).alias("confidence"), F.round(cancer, 6).alias("p_cancer"))


@check("prob_margin", f"WITH {SCORED_SQL} SELECT vec_id, model_alias, target_label, target_prob, source_prob, target_source_prob_margin, target_correct FROM scored")
def prob_margin(spark, sf):
    return scored(spark, sf).select("vec_id", "model_alias", "target_label", "target_prob", "source_prob", "target_source_prob_margin", "target_correct")


@check("batch_score", f"WITH {SCORED_SQL} SELECT vec_id, model_alias, pred_label, round(confidence, 6) AS confidence FROM predicted")
def batch_score(spark, sf):
    """The model seam: a linear map of the vectors as predictor."""
    import numpy as np

    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    inputs = _embeddings(spark, sf).withColumn("model_alias", models)

    def predict(batch):
        v = np.stack(batch["v"].to_list()).reshape(len(batch), -1, 4)
        m = np.array([MODELS.index(m) for m in batch["model_alias"]])[:, None]
        weight = (m + 1) * (np.arange(v.shape[1]) + 1) % 7 - 3
        return 2 * (v * weight[:, :, None]).sum(axis=1)

    out = seams.batch_score(inputs, predict, CLASSES)
    return out.select("vec_id", "model_alias", "pred_label", F.round("confidence", 6).alias("confidence"))


EXPECTED = "CASE WHEN vec_id % 5 <> 0 THEN source_label END"


def _expected(spark, sf):
    return predictions(spark, sf).withColumn("expected_label", F.expr(EXPECTED))


@check("pred_distribution", f"WITH {SCORED_SQL} SELECT model_alias, pred_label, count(*) AS n FROM predicted GROUP BY ALL")
def pred_distribution(spark, sf):
    return metrics.distribution(predictions(spark, sf), "pred_label", ["model_alias"])


@check("confusion", f"WITH {SCORED_SQL} SELECT expected_label, pred_label, count(*) AS n FROM (SELECT *, {EXPECTED} AS expected_label FROM predicted) q WHERE expected_label IS NOT NULL GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(_expected(spark, sf), "expected_label", "pred_label")


@check("confusion_wide", f"WITH {SCORED_SQL} SELECT expected_label, " + ", ".join(f"count(*) FILTER (pred_label = '{c}') AS {c}" for c in CLASSES[1:]) + f", count(*) FILTER (pred_label = '{CLASSES[0]}') AS other FROM (SELECT *, {EXPECTED} AS expected_label FROM predicted) q WHERE expected_label IS NOT NULL GROUP BY expected_label")
def confusion_wide(spark, sf):
    """One predicted label isn't in the list: it counts as another."""
    return metrics.confusion_wide(_expected(spark, sf), "expected_label", "pred_label", CLASSES[1:])


@check("consistency", f"""WITH {SCORED_SQL}, q AS (SELECT *, {EXPECTED} AS expected_label FROM predicted) SELECT count(*) AS n_images, count(expected_label) AS n_with_expected_label,
  round(count(*) FILTER (pred_label = expected_label) / count(expected_label), 6) AS consistency_top1, round(avg(confidence), 6) AS avg_confidence FROM q""")
def consistency(spark, sf):
    return rounded(metrics.consistency(_expected(spark, sf)))


@check("macro_consistency", f"""WITH {SCORED_SQL}, q AS (SELECT *, {EXPECTED} AS expected_label FROM predicted) SELECT round(sum(top1) / 3, 6) AS macro_consistency FROM (SELECT expected_label, avg(CASE WHEN pred_label = expected_label THEN 1.0::DOUBLE ELSE 0 END) AS top1 FROM q WHERE expected_label IN ('cancer', 'opmd', 'absent') GROUP BY expected_label) a""")
def macro_consistency(spark, sf):
    return rounded(metrics.macro_consistency(metrics.class_accuracy(_expected(spark, sf)), ["cancer", "opmd", "absent"]))


SUMMARY_SQL = """summary AS (SELECT {by}, prompt_mode, count(*) AS n, avg(CASE WHEN pred_label = target_label THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(target_prob) AS target_prob_mean, avg(source_prob) AS source_prob_mean,
  avg(target_source_prob_margin) AS target_source_prob_margin_mean, avg(CASE WHEN target_source_prob_margin > 0 THEN 1.0::DOUBLE WHEN target_source_prob_margin IS NOT NULL THEN 0 END) AS positive_margin_rate, 0.5::DOUBLE * (avg(target_source_prob_margin) + 1) AS target_source_prob_margin_score FROM {src} GROUP BY {by}, prompt_mode)"""


@check("metric_summary", f"WITH {SCORED_SQL}, {SUMMARY_SQL.format(by='model_alias', src='scored')} SELECT model_alias, prompt_mode, n, round(top1, 6) AS top1, round(target_prob_mean, 6) AS target_prob_mean, round(source_prob_mean, 6) AS source_prob_mean, round(target_source_prob_margin_mean, 6) AS target_source_prob_margin_mean, round(positive_margin_rate, 6) AS positive_margin_rate, round(target_source_prob_margin_score, 6) AS target_source_prob_margin_score FROM summary")
def metric_summary(spark, sf):
    return rounded(metrics.mode_summary(scored(spark, sf)))


@check("top1_by_label", f"WITH {SCORED_SQL} SELECT model_alias, prompt_mode, target_label, source_label, count(*) AS n, round(avg(CASE WHEN pred_label = target_label THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1 FROM scored GROUP BY GROUPING SETS ((model_alias, prompt_mode, target_label), (model_alias, prompt_mode, source_label))")
def top1_by_label(spark, sf):
    return rounded(metrics.top1_by_label(scored(spark, sf)))


CANDIDATE_SQL = "cand AS (SELECT *, concat(model_alias, '_', CAST(vec_id % 7 AS VARCHAR)) AS checkpoint FROM scored)"
REWARD_SQL = f"""{CANDIDATE_SQL}, {SUMMARY_SQL.format(by='checkpoint', src='cand')},
reward AS (SELECT *, round(0.4::DOUBLE * same_class_target_prob_mean + 0.6::DOUBLE * cross_class_margin_score, 6) AS combined_reward FROM (SELECT checkpoint, round(coalesce(max(top1) FILTER (prompt_mode = 'same_class'), 0), 6) AS same_class_target_top1, round(coalesce(max(top1) FILTER (prompt_mode = 'cross_class'), 0), 6) AS cross_class_target_top1,
  round(coalesce(max(target_prob_mean) FILTER (prompt_mode = 'same_class'), 0), 6) AS same_class_target_prob_mean, round(coalesce(max(target_source_prob_margin_mean) FILTER (prompt_mode = 'cross_class'), -1), 6) AS cross_class_target_source_prob_margin_mean, round(coalesce(max(target_source_prob_margin_score) FILTER (prompt_mode = 'cross_class'), 0), 6) AS cross_class_margin_score FROM summary GROUP BY checkpoint) q),
placed AS (SELECT *, row_number() OVER (ORDER BY checkpoint) - 1 AS position FROM reward),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY combined_reward DESC, cross_class_margin_score DESC, cross_class_target_top1 DESC, same_class_target_prob_mean DESC, same_class_target_top1 DESC, position) AS INT) AS rank FROM placed)"""


def candidates(spark, sf):
    """Rewards of all candidates at once; metrics rounded so that both engines rank the same numbers."""
    rows = scored(spark, sf).withColumn("checkpoint", F.concat("model_alias", F.lit("_"), (F.col("vec_id") % 7).cast("string")))
    summary = rounded(metrics.mode_summary(rows, ["checkpoint"]))
    from pyspark.sql import Window

    reward = rounded(metrics.combined_reward(summary, ["checkpoint"], 0.4, 0.6))
    return reward.withColumn("position", (F.row_number().over(Window.orderBy("checkpoint")) - 1).cast("bigint"))  # a listing of candidates


@check("combined_reward", f"WITH {SCORED_SQL}, {REWARD_SQL} SELECT * FROM placed")
def combined_reward(spark, sf):
    return candidates(spark, sf)


@check("ckpt_rank", f"WITH {SCORED_SQL}, {REWARD_SQL} SELECT rank, checkpoint, combined_reward, cross_class_margin_score FROM ranked")
def ckpt_rank(spark, sf):
    return ranking.rank_candidates(candidates(spark, sf)).select("rank", "checkpoint", "combined_reward", "cross_class_margin_score")


@check("ckpt_best", f"WITH {SCORED_SQL}, {REWARD_SQL} SELECT checkpoint, combined_reward FROM ranked WHERE rank = 1")
def ckpt_best(spark, sf):
    return ranking.best_candidate(candidates(spark, sf)).select("checkpoint", "combined_reward")


@check("panel_index", f"WITH {SCORED_SQL} SELECT vec_id, target_label, prompt_mode, concat(prompt_mode, '/', CAST(vec_id AS VARCHAR), '__to__', target_label, '.png') AS panel, " + ", ".join(f"max(pred_label) FILTER (model_alias = '{m}') AS {m}" for m in MODELS) + " FROM scored GROUP BY ALL")
def panel_index(spark, sf):
    wide = ranking.panel_index(scored(spark, sf), MODELS, ["vec_id", "target_label", "prompt_mode"])
    return wide.withColumn("panel", F.concat("prompt_mode", F.lit("/"), F.col("vec_id").cast("string"), F.lit("__to__"), "target_label", F.lit(".png")))


@check("eval_f1", """SELECT round(avg(-ln((doc_id % 97 + 1) / 99.0::DOUBLE)), 6) AS val_loss, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS val_acc,
  round(2.0::DOUBLE * count(*) FILTER (quality = 1 AND toxic = 1) / (2 * count(*) FILTER (quality = 1 AND toxic = 1) + count(*) FILTER (quality <> toxic)), 6) AS val_f1 FROM labels""")
def eval_f1(spark, sf):
    rows = table(spark, sf, "labels").withColumn("p", (F.col("doc_id") % 97 + 1) / F.lit(99.0))
    return rounded(metrics.evaluate_binary(rows, "quality", "toxic", "p"))


@check("token_examples", r"""WITH t AS (SELECT doc_id, concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS name, coalesce(nullif(regexp_extract(concat(text, ' diagnosis: ', lang), '(?i)(?:diagnosis|tissue\s*pattern):\s*([A-Za-z0-9_]+)', 1), ''), 'x') AS token FROM documents)
  SELECT token, count(*) AS n, (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM t b WHERE b.token = a.token ORDER BY name LIMIT 3) q) AS examples FROM t a GROUP BY token""")
def token_examples(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.expr("concat(source, '/', lpad(cast(doc_id as string), 8, '0'))").alias("name"), prompts.caption_token(F.concat("text", F.lit(" diagnosis: "), "lang")).alias("token")
    )
    return metrics.token_examples(docs, "token", "name").withColumn("examples", F.array_join("examples", ","))


@check("label_vocab", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_index FROM (SELECT lang AS label FROM documents UNION SELECT o_orderpriority FROM orders UNION SELECT lower(c_mktsegment) FROM customer) q")
def label_vocab(spark, sf):
    parts = [table(spark, sf, "documents").select(F.col("lang").alias("l")), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("l")), table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("l"))]
    return metrics.label_vocabulary(parts, "l")


@check("best_epoch", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := -f, b := o_orderkey)) AS best_epoch, max(f) AS best_score FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000) AS f FROM orders) q GROUP BY o_custkey")
def best_epoch(spark, sf):
    history = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("val_f1"))
    return ranking.best_epoch(history, ["o_custkey"])
