"""Counts, vocabularies and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import join_groups


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Non-NULL values by falling frequency; ties by value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def label_vocabulary(tables: Sequence[DataFrame], label: str) -> DataFrame:
    """Sorted distinct labels over several tables with their index (a vocabulary is a handful of rows)."""
    parts = [t.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct() for t in tables]
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    order = Window.orderBy("label")
    return labels.distinct().withColumn("label_index", (F.row_number().over(order) - 1).cast("int"))


def pairing_stats(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Totals of a pairing: images, masks, paired rows, images without a mask.

    One aggregate over a left join counts both sides of the pairing.
    """
    have = masks.select(key).distinct().withColumn("_mask", F.lit(1))
    sides = images.join(have, key, "left").agg(
        F.count("*").alias("total_images"), F.count("_mask").alias("paired_rows"), F.count_if(F.col("_mask").isNull()).alias("missing_masks")
    )
    both = sides.unionByName(masks.agg(F.count("*").alias("total_masks")), allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in ("total_images", "total_masks", "paired_rows", "missing_masks")])


def materialize_stats(tiles: DataFrame, sources: DataFrame, existing: DataFrame, source_key: str, tile_key: Sequence[str]) -> DataFrame:
    """Tiles by outcome: ``missing`` (rows whose source is gone), ``skipped`` (already there) or ``written``."""
    from tessella.operators.joins import mark_existing

    marked = mark_existing(tiles, existing, tile_key).join(sources.distinct().withColumn("_src", F.lit(True)), source_key, "left")
    status = F.when(F.col("_src").isNull(), "missing").when(F.col("reused_existing"), "skipped").otherwise("written")
    return marked.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.countDistinct(source_key).alias("sources"))


def distribution(rows: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count per non-NULL value, within the groups of ``by``."""
    return rows.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts of every pair of expected and predicted label that occurs; rows without an expected label don't count."""
    return rows.where(F.col(expected).isNotNull()).groupBy(expected, predicted).agg(F.count("*").alias("n"))


def confusion_wide(rows: DataFrame, expected: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Confusion counts with one column per class, and ``other`` for predictions outside of them (or none)."""
    named = [F.count_if(F.col(predicted) == c).alias(c) for c in classes]
    other = F.count_if(F.coalesce(~F.col(predicted).isin(list(classes)), F.lit(True))).alias("other")
    return rows.where(F.col(expected).isNotNull()).groupBy(expected).agg(*named, other)


def class_accuracy(rows: DataFrame, expected: str = "expected_label", predicted: str = "pred_label") -> DataFrame:
    """Accuracy per expected label."""
    return rows.where(F.col(expected).isNotNull()).groupBy(expected).agg(
        F.count("*").alias("n"), F.avg((F.col(expected) == F.col(predicted)).cast("double")).alias("top1")
    )


def consistency(rows: DataFrame, expected: str = "expected_label", predicted: str = "pred_label") -> DataFrame:
    """Rows, rows with an expected label, share predicted as expected (NULL when none has one), mean confidence."""
    known = F.col(expected).isNotNull()
    hit = F.count_if(known & (F.col(expected) == F.col(predicted)))
    return rows.agg(
        F.count("*").alias("n_images"), F.count_if(known).alias("n_with_expected_label"),
        F.try_divide(hit, F.count_if(known)).alias("consistency_top1"), F.avg("confidence").alias("avg_confidence"),
    )


def macro_consistency(accuracy: DataFrame, tokens: Sequence[str], expected: str = "expected_label", by: Sequence[str] = ()) -> DataFrame:
    """Mean of class accuracies over all asked tokens; absent ones count as zero."""
    asked = accuracy.where(F.col(expected).isin(list(tokens)))
    return asked.groupBy(*by).agg((F.coalesce(F.sum("top1"), F.lit(0.0)) / F.lit(len(tokens))).alias("macro_consistency"))


def mode_summary(rows: DataFrame, by: Sequence[str] = ("model_alias",)) -> DataFrame:
    """Benchmark metrics per model and prompt mode."""
    m = F.col("target_source_prob_margin")
    summary = rows.groupBy(*by, "prompt_mode").agg(
        F.count("*").alias("n"),
        F.avg((F.col("pred_label") == F.col("target_label")).cast("double")).alias("top1"),
        F.avg("target_prob").alias("target_prob_mean"), F.avg("source_prob").alias("source_prob_mean"),
        F.avg(m).alias("target_source_prob_margin_mean"),
        F.avg(F.when(m.isNotNull(), (m > 0).cast("double"))).alias("positive_margin_rate"),
    )
    return summary.withColumn("target_source_prob_margin_score", (F.col("target_source_prob_margin_mean") + 1.0) * 0.5)


def top1_by_label(rows: DataFrame) -> DataFrame:
    """Top-1 by target label and by source label in one pass over grouping sets."""
    hit = F.avg((F.col("pred_label") == F.col("target_label")).cast("double")).alias("top1")
    model, mode, target, source = (F.col(c) for c in ("model_alias", "prompt_mode", "target_label", "source_label"))
    return rows.groupingSets([[model, mode, target], [model, mode, source]], model, mode, target, source).agg(F.count("*").alias("n"), hit)


def combined_reward(summary: DataFrame, by: Sequence[str], same_weight: float = 0.5, cross_weight: float = 0.5) -> DataFrame:
    """One row per candidate: metrics of both modes side by side and their weighted reward; missing metrics are zero
    (the mean margin -1)."""
    def pick(mode, col, default):
        return F.coalesce(F.max(F.when(F.col("prompt_mode") == mode, F.col(col))), F.lit(default))

    wide = summary.groupBy(*by).agg(
        pick("same_class", "top1", 0.0).alias("same_class_target_top1"),
        pick("cross_class", "top1", 0.0).alias("cross_class_target_top1"),
        pick("same_class", "target_prob_mean", 0.0).alias("same_class_target_prob_mean"),
        pick("cross_class", "target_source_prob_margin_mean", -1.0).alias("cross_class_target_source_prob_margin_mean"),
        pick("cross_class", "target_source_prob_margin_score", 0.0).alias("cross_class_margin_score"),
    )
    reward = F.lit(same_weight) * F.col("same_class_target_prob_mean") + F.lit(cross_weight) * F.col("cross_class_margin_score")
    return wide.withColumn("combined_reward", reward)


def evaluate_binary(rows: DataFrame, truth: str, predicted: str, prob_of_truth: str) -> DataFrame:
    """Mean log loss, accuracy and F1 of the positive class (0 when undefined). Probabilities below 1e-12 count as that."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    return rows.agg(
        F.avg(-F.log(F.greatest(F.col(prob_of_truth), F.lit(1e-12)))).alias("val_loss"), F.avg((y == p).cast("double")).alias("val_acc"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("val_f1"),
    )


def token_examples(rows: DataFrame, token: str, name: str, examples: int = 3) -> DataFrame:
    """Count per token, NULL being one, with its first few names; names are cut per token before they are collected."""
    first = F.row_number().over(Window.partitionBy(token).orderBy(name))
    shown = rows.select(token, name, first.alias("_r")).where(F.col("_r") <= examples).groupBy(token).agg(F.array_sort(F.collect_list(name)).alias("examples"))
    return join_groups(rows.groupBy(token).agg(F.count("*").alias("n")), shown, [token])


def resolve_classes(vocabulary: DataFrame, expected: int | None, fallback: Sequence[str], default: Sequence[str]) -> list[str]:
    """Class names of a model head: the vocabulary when its size fits, else the fallback tokens, else the default four,
    else numbered names.  Reads at most ``expected + 1`` labels; without an expected size the head takes every label there is."""
    asked = vocabulary.select("label").orderBy("label")
    found = [r["label"] for r in (asked if expected is None else asked.limit(expected + 1)).collect()]
    unique = sorted(set(fallback))
    if expected is None:
        return found or unique
    for names in (found, unique, sorted(default)):
        if len(names) == expected:
            return names
    return [f"class_{i}" for i in range(expected)]
