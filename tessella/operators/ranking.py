"""Ranking candidates and epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REWARD_KEYS = (
    "combined_reward", "cross_class_margin_score", "cross_class_target_top1", "same_class_target_prob_mean", "same_class_target_top1",
)
CONSISTENCY_KEYS = ("macro_consistency", "consistency_top1")


def rank_candidates(rows: DataFrame, keys: Sequence[str] = REWARD_KEYS, tie: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """Rank from 1 by falling metrics, ties in listing order; all runs are ranked in one pass when ``by`` names them."""
    order = Window.partitionBy(*by).orderBy(*[F.desc(k) for k in keys], tie)
    return rows.withColumn("rank", F.row_number().over(order))


def best_candidate(rows: DataFrame, keys: Sequence[str] = REWARD_KEYS, tie: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """First of the ranking, by a plain aggregate."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*keys, -F.col(tie)))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def best_epoch(history: DataFrame, by: Sequence[str], epoch: str = "epoch", score: str = "val_f1") -> DataFrame:
    """Earliest epoch with the largest score."""
    return history.groupBy(*by).agg(F.max_by(F.col(epoch), F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"), F.max(score).alias("best_score"))


def panel_index(rows: DataFrame, models: Sequence[str], by: Sequence[str] = ("source_key", "target_label", "prompt_mode")) -> DataFrame:
    """Predictions of all models side by side per source and target."""
    return rows.groupBy(*by).pivot("model_alias", list(models)).agg(F.max("pred_label"))
