"""The curriculum loop over tables: all checkpoints of all cycles are ranked and folded at once.

Scored rows carry ``run, cycle, checkpoint, position`` besides the benchmark columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import curriculum, metrics, ranking
from tessella.operators.sampling import join_groups


def rank_checkpoints(scored: DataFrame, same_weight: float = 0.5, cross_weight: float = 0.5) -> DataFrame:
    """Ranking of every cycle's checkpoints by combined reward."""
    by = ["run", "cycle", "checkpoint", "position"]
    reward = metrics.combined_reward(metrics.mode_summary(scored, by), by, same_weight, cross_weight)
    return ranking.rank_candidates(reward, by=["run", "cycle"])


def loop_history(ranked: DataFrame, epsilon: float, patience: int = 0, revert: bool = True) -> DataFrame:
    """State of every cycle from its best checkpoint; the best's metrics stay alongside."""
    best = ranked.where("rank = 1").withColumn("score", F.col("combined_reward"))
    folded = curriculum.reward_fold(best.select("run", "cycle", "score", "checkpoint"), epsilon, patience, revert)
    return folded.join(best.drop("score", "rank", "position"), ["run", "cycle", "checkpoint"])


def score_holdout(history: DataFrame, scored: DataFrame, same_weight: float = 0.5, cross_weight: float = 0.5) -> DataFrame:
    """History with the metrics of each cycle's best checkpoint on rows that the selection did not use (``holdout_...``; NULL where
    it was not scored on any)."""
    by = ["run", "cycle", "checkpoint"]
    best = history.select(*by).distinct()
    wanted = join_groups(scored, best, by, "left_semi")
    reward = metrics.combined_reward(metrics.mode_summary(wanted, by), by, same_weight, cross_weight)
    held = reward.select(
        *by, F.col("combined_reward").alias("holdout_combined_reward"), F.col("cross_class_margin_score").alias("holdout_cross_class_margin_score"),
        F.col("cross_class_target_source_prob_margin_mean").alias("holdout_cross_class_target_prob_margin_mean"), F.col("cross_class_target_top1").alias("holdout_cross_class_target_top1"),
        F.col("same_class_target_prob_mean").alias("holdout_same_class_target_prob_mean"), F.col("same_class_target_top1").alias("holdout_same_class_target_top1"),
    )
    return join_groups(history, held, by, "left")


def next_curriculum(history: DataFrame, scored: DataFrame, anchors: DataFrame, rules: curriculum.Rules) -> DataFrame:
    """Training set after each cycle: the anchors, and accepted rows of the checkpoint the next cycle starts from
    (the best one after a clear drop, else the cycle's own)."""
    state = F.when(F.col("reverted"), F.col("global_best_cycle")).otherwise(F.col("cycle"))
    chosen = history.select("run", F.col("cycle").alias("for_cycle"), state.alias("cycle"), F.col("next_start_checkpoint").alias("checkpoint"))
    rows = curriculum.curriculum_rows(scored.join(chosen, ["run", "cycle", "checkpoint"]), rules)
    pseudo = rows.select("run", "for_cycle", "stem", F.lit("pseudo").alias("origin"), F.col("prompt").alias("caption"))
    per_cycle = history.select("run", F.col("cycle").alias("for_cycle"))
    real = anchors.where("status = 'kept'").select("run", "stem", F.lit("real").alias("origin"), "caption")
    return per_cycle.join(real, "run").unionByName(pseudo)
