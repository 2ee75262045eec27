"""Candidate benchmark: source sample, task grid, scoring, metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import boxes, naming, prompts, scores
from tessella.operators import joins, sampling, seams


@dataclass(frozen=True)
class Benchmark:
    """Parameters of a benchmark."""

    tokens: Sequence[str]
    template: str = "photo, diagnosis: {token}{descriptor_suffix}"
    descriptors: Mapping[str, str] = field(default_factory=dict)
    sources_per_class: int = 6
    max_sources: int = 0
    seed: int = 42
    same_strength: float = 0.35
    cross_strength: float = 0.55
    target_strength: Mapping[str, float] = field(default_factory=dict)
    same_dilate: float = 0.0
    cross_dilate: float = 0.0
    target_dilate: Mapping[str, float] = field(default_factory=dict)


def select_sources(rows: DataFrame, label: str, mask_names: DataFrame, mask_paths: DataFrame, p: Benchmark) -> DataFrame:
    """The shared sample: rows of the asked labels that have a mask (their own path, or their name in the mask folder),
    balanced, without repeated file names, capped, with a dense ``source_index``.

    ``mask_names(mask_name)`` and ``mask_paths(mask_path)`` are listings.
    """
    named = rows.where(F.col(label).isin(list(p.tokens))).withColumn("mask_name", naming.mask_name(F.col("filename"), F.col("image_path")))
    in_folder = mask_names.select("mask_name").distinct().withColumn("_named", F.lit(True))
    own = mask_paths.select("mask_path").distinct().withColumn("_own", F.lit(True))
    usable = named.join(in_folder, "mask_name", "left").join(own, "mask_path", "left").where("_named OR _own")
    usable = usable.withColumn("mask_in_folder", F.coalesce("_named", F.lit(False))).drop("_named", "_own")
    key = ["filename", "image_path", "tile_y", "tile_x"]
    chosen = sampling.ordered_strata(usable, label, p.sources_per_class, p.seed, key, "_order")
    unique = sampling.keep_first(chosen, ["filename"], ["_order"])
    capped = sampling.exact_sample(unique, p.max_sources, p.seed, key)
    return sampling.with_position(capped, ["_order"], "source_index").drop("_order")


def benchmark_tasks(sources: DataFrame, label: str, mask_folder: str, models: Mapping[str, str], p: Benchmark) -> DataFrame:
    """One row per source, target label and model, with everything the editor needs."""
    box = boxes.crop_box(*[F.col(f"tile_{c}") for c in ("x", "y", "size", "w", "h")])
    folder_mask = F.concat(F.lit(mask_folder.rstrip("/") + "/"), F.col("mask_name"))
    own = F.nullif(F.trim("mask_path"), F.lit(""))
    ready = sources.withColumn("_box", box).select(
        "source_index", naming.source_key(F.col("source_index"), naming.mask_name(F.col("filename"), F.col("image_path"))).alias("source_key"),
        F.col("image_path").alias("source_path"), F.when(F.col("mask_in_folder"), folder_mask).otherwise(F.coalesce(own, folder_mask)).alias("mask_path"),
        "mask_name", F.col("_box.x0").alias("tile_x"), F.col("_box.y0").alias("tile_y"),
        (F.col("_box.x1") - F.col("_box.x0")).alias("tile_w"), (F.col("_box.y1") - F.col("_box.y0")).alias("tile_h"), F.col(label).alias("source_label"),
    )
    grid = joins.task_grid(ready, p.tokens, list(models), p.seed)
    source, target = F.col("source_label"), F.col("target_label")
    from tessella.functions.labels import lookup

    return grid.select(
        "*", prompts.render(p.template, target, p.descriptors).alias("prompt"),
        scores.task_parameter(source, target, p.same_strength, p.cross_strength, p.target_strength).alias("strength"),
        scores.task_parameter(source, target, p.same_dilate, p.cross_dilate, p.target_dilate).alias("mask_dilate_px"),
        lookup(F.col("model_alias"), dict(models)).alias("lora_checkpoint"),
        F.concat(F.lit("generated/"), "model_alias", F.lit("/"), "source_key", F.lit("__to__"), "target_label", F.lit(".png")).alias("generated_path"),
    )


def score_tasks(tasks: DataFrame, predict: Callable, classes: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Scored rows: prediction, probabilities of source and target, margin, and whether the output was there before.

    ``predict`` sees a batch of task rows (join pixel tiles to them first) and returns logits.
    """
    rows = joins.mark_existing(tasks, existing, "generated_path") if existing is not None else tasks.withColumn("reused_existing", F.lit(False))
    scored = seams.batch_score(rows, predict, classes)
    target = scores.probability_of(F.col("probs"), F.col("target_label"), classes)
    source = scores.probability_of(F.col("probs"), F.col("source_label"), classes)
    return scored.select(
        "*", target.alias("target_prob"), source.alias("source_prob"),
        scores.margin(F.col("source_label"), F.col("target_label"), source, target).alias("target_source_prob_margin"),
        (F.col("pred_label") == F.col("target_label")).alias("target_correct"),
    ).drop("probs")
