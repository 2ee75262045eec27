"""The reward loop: history fold, accepted rows, anchors, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import labels, naming, prompts
from tessella.functions.coerce import to_float
from tessella.operators import sampling
from tessella.operators.sampling import join_groups

CHUNK = 4096  # cycles per window partition


def best_after(scores: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk of scores makes of the best before it, as a step function ``(limits, values)``: a best whose sum with ``epsilon`` is below a
    limit becomes the value of the first such limit; any higher best stays.

    Only a score above all before it can be the first to beat some best. From there on one improvement leads to the next, so that
    each of these scores has an end; neighbours that end alike are one step.
    """
    rising = scores[scores > np.maximum.accumulate(np.append(-np.inf, scores[:-1]))]
    n = len(rising)
    follower = np.searchsorted(rising, rising + epsilon, "right")
    ends = rising.copy()
    for i in range(n - 1, -1, -1):
        if follower[i] < n:
            ends[i] = ends[follower[i]]
    last = np.append(ends[1:] != ends[:-1], True) if n else np.zeros(0, bool)
    return rising[last], ends[last]


def _starting_best(peaks: DataFrame, epsilon: float) -> DataFrame:
    """``run, _chunk, _start``: the best before each chunk's first row."""
    run, chunk = peaks.schema["run"], peaks.schema["_chunk"]
    steps = T.StructType([run, chunk, *T.StructType.fromDDL("limits array<double>, ends array<double>").fields])

    def summarise(batches):
        place, held = None, []

        def close():
            limits, ends = best_after(np.array(held, dtype=np.float64), epsilon)
            return (*place, limits.tolist(), ends.tolist())

        for batch in batches:
            done = []
            for r, k, s in zip(batch["run"], batch["_chunk"], batch["score"]):
                if (r, k) != place:
                    done += [close()] if held else []
                    place, held = (r, k), []
                held.append(s)
            yield pd.DataFrame(done, columns=steps.names)
        if held:
            yield pd.DataFrame([close()], columns=steps.names)

    def carry(batches):
        current, best = None, -1.0
        for batch in batches:
            starts = []
            for r, limits, ends in zip(batch["run"], batch["limits"], batch["ends"]):
                if r != current:
                    current, best = r, -1.0
                starts.append(best)
                at = int(np.searchsorted(limits, best + epsilon, "right"))
                best = float(ends[at]) if at < len(ends) else best
            yield batch[["run", "_chunk"]].assign(_start=starts)

    functions = peaks.repartition("run", "_chunk").sortWithinPartitions("run", "_chunk", "cycle").mapInPandas(summarise, steps)
    ordered = functions.repartition("run").sortWithinPartitions("run", "_chunk")
    return ordered.mapInPandas(carry, T.StructType([run, chunk, T.StructField("_start", T.DoubleType())]))


def reward_fold(history: DataFrame, epsilon: float, patience: int = 0, revert: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Fold each run's cycles ``(run, cycle from 1, score, checkpoint)`` into loop state.

    A cycle improves the best (which starts at -1) when it beats it by more than ``epsilon``; otherwise the idle count grows
    and the run stops once it reaches ``patience``.  A clear drop starts the next cycle from the best checkpoint.

    Only a running maximum can improve the best, since the best never trails the maximum by more than ``epsilon``.  Running
    maxima are found in chunks of cycles. What a chunk makes of the best that reaches it is a step function; those functions are
    applied one after the other, so that every chunk knows the best it starts with, and then all chunks are folded at once, each by its own
    few rows with constant state. Only the functions of a run meet in one task, also of a run that rises in every cycle.
    """
    # A missing score counts as zero; one that isn't a number never improves and must not enter a maximum, where Spark has it on top.
    rows = history.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("_chunk", F.floor(F.col("cycle") / chunk))
    number = F.when(~F.isnan("score"), F.col("score"))
    per_run = Window.partitionBy("run").orderBy("_chunk")
    earlier = per_run.rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy("run", "_chunk").orderBy("cycle")

    tops = rows.groupBy("run", "_chunk").agg(F.max(number).alias("_m")).withColumn("_prev", F.max("_m").over(earlier)).drop("_m")
    peak = F.greatest("_prev", F.max(number).over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)))
    higher = (F.col("score") > F.col("_peak") - 1e-9) & (F.col("score") != F.col("_peak"))  # an equal score never improves
    peaks = join_groups(rows, tops, ["run", "_chunk"]).withColumn("_peak", peak).where(~F.isnan("score") & (F.col("_peak").isNull() | higher))

    def fold(batches):
        place, best = None, -1.0
        for batch in batches:
            taken = []
            for r, k, c, s, start in zip(batch["run"], batch["_chunk"], batch["cycle"], batch["score"], batch["_start"]):
                if (r, k) != place:
                    place, best = (r, k), start
                if s > best + epsilon:
                    best = s
                    taken.append((r, c, s))
            yield pd.DataFrame(taken, columns=["run", "cycle", "score"]).astype(batch[["run", "cycle", "score"]].dtypes)

    kept = peaks.select("run", "_chunk", "cycle", "score")
    started = join_groups(kept, _starting_best(kept, epsilon), ["run", "_chunk"])
    schema = kept.select("run", "cycle", "score").schema
    accepted = started.repartition("run", "_chunk").sortWithinPartitions("run", "_chunk", "cycle").mapInPandas(fold, schema)
    marked = join_groups(rows, accepted.select("run", "cycle", F.lit(True).alias("_hit")), ["run", "cycle"], "left")
    state = F.when(F.col("_hit"), F.struct("cycle", "score", "checkpoint"))
    carried = (
        marked.groupBy("run", "_chunk").agg(F.max(state).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    )
    now = F.coalesce(F.last(state, ignorenulls=True).over(in_chunk), F.col("_carry"))
    folded = join_groups(marked, carried, ["run", "_chunk"]).withColumn("_best", now)
    g = F.coalesce("_best.score", F.lit(-1.0))
    back = F.lit(revert) & F.col("_best").isNotNull() & ~F.isnan("score") & (F.col("score") + epsilon < g)
    out = folded.select(
        "run", "cycle", "score", "checkpoint", F.coalesce("_hit", F.lit(False)).alias("improved_global_best"), g.alias("global_best"),
        F.col("_best.checkpoint").alias("global_best_checkpoint"), F.col("_best.cycle").alias("global_best_cycle"), (F.col("cycle") - F.coalesce("_best.cycle", F.lit(0))).cast("int").alias("no_improve"),
        back.alias("reverted"), F.when(back, F.col("_best.checkpoint")).otherwise(F.col("checkpoint")).alias("next_start_checkpoint"),
    )
    if patience <= 0:
        return out
    stops = out.where(F.col("no_improve") >= patience).groupBy("run").agg(F.min("cycle").alias("_stop"))
    return join_groups(out, stops, ["run"], "left").where(F.col("_stop").isNull() | (F.col("cycle") <= F.col("_stop"))).drop("_stop")


@dataclass(frozen=True)
class Rules:
    """Which scored rows enter the next training set, and how often."""

    cross_repeat: int = 2
    same_repeat: int = 1
    min_cross_margin: float | None = None
    min_cross_prob: float | None = None
    min_same_prob: float | None = None
    target_repeat: Mapping[str, int] = field(default_factory=dict)


def _below(col: str, limit: float | None) -> Column:
    """A rule that is set fails on NULL too."""
    value = to_float(F.col(col))
    return F.lit(False) if limit is None else value.isNull() | (value < limit)


def judge_rows(rows: DataFrame, rules: Rules, generated: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """Scored rows with ``status`` (``kept`` or the rule that dropped them) and ``repeat``.

    With listings of the generated images (``generated_path``) and masks (``mask_path``), rows whose files are gone get
    ``missing_file``.
    """
    cross = F.col("prompt_mode") == "cross_class"
    own = labels.lookup(F.col("target_label"), dict(rules.target_repeat), rules.cross_repeat) if rules.target_repeat else F.lit(rules.cross_repeat)
    repeat = F.when(cross, F.greatest(F.lit(rules.cross_repeat), own)).otherwise(F.lit(rules.same_repeat))
    status = (
        F.when(cross & _below("target_source_prob_margin", rules.min_cross_margin), "dropped_cross_margin")
        .when(cross & _below("target_prob", rules.min_cross_prob), "dropped_cross_prob")
        .when(~cross & _below("target_prob", rules.min_same_prob), "dropped_same_prob")
        .when(repeat <= 0, "no_repeat")
        .otherwise("kept")
    )
    judged = rows.withColumn("repeat", repeat).withColumn("status", status)
    for listing, key in ((generated, "generated_path"), (masks, "mask_path")):
        if listing is not None:
            there = listing.select(key).distinct().withColumn("_there", F.lit(True))
            gone = (F.col("status") == "kept") & F.col("_there").isNull()
            judged = judged.join(there, key, "left").withColumn("status", F.when(gone, "missing_file").otherwise(F.col("status"))).drop("_there")
    return judged


def curriculum_rows(rows: DataFrame, rules: Rules, generated: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """Accepted rows repeated under ``..__r01``, ``..__r02``, ... names."""
    kept = judge_rows(rows, rules, generated, masks).where(F.col("status") == "kept")
    base = F.concat(F.col("prompt_mode"), F.lit("_"), naming.safe_name(F.col("source_key")), F.lit("__to__"), naming.safe_name(F.col("target_label")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeat")))).withColumn(
        "stem", F.concat(base, F.format_string("__r%02d", "copy"))
    )


def curriculum_stats(judged: DataFrame) -> DataFrame:
    """Counters of one curriculum build."""
    ok = F.col("status") == "kept"
    cross = F.col("prompt_mode") == "cross_class"
    drop = lambda s: F.count_if(F.col("status") == s)
    return judged.agg(
        F.coalesce(F.sum(F.when(ok, F.col("repeat"))), F.lit(0)).cast("bigint").alias("pseudo_rows_kept"),
        F.count_if(ok & cross).alias("pseudo_cross_rows"), F.count_if(ok & ~cross).alias("pseudo_same_rows"),
        drop("dropped_cross_margin").alias("pseudo_dropped_cross_margin"), drop("dropped_cross_prob").alias("pseudo_dropped_cross_prob"),
        drop("dropped_same_prob").alias("pseudo_dropped_same_prob"),
    )


def real_anchors(rows: DataFrame, label: str, per_class: int, seed: int, images: DataFrame, masks: DataFrame, template: str,
                 descriptors: Mapping[str, str], tokens: Sequence[str], use_descriptors: bool = False) -> DataFrame:
    """Balanced anchors with status ``missing_image``, ``missing_mask`` or ``kept``, their stem and caption.

    ``rows``: ``image_path, filename`` and the label; ``images(image_path)`` and ``masks(mask_name)`` are listings.
    """
    sample = sampling.ordered_strata(rows, label, per_class, seed, ["image_path"], "anchor_index")
    named = sample.withColumn("mask_name", naming.mask_name(F.col("filename"), F.col("image_path")))
    have_image = images.select("image_path").distinct().withColumn("_img", F.lit(True))
    have_mask = masks.select("mask_name").distinct().withColumn("_msk", F.lit(True))
    token = labels.normalise_token(F.col(label), {}, tokens)
    return (
        named.join(have_image, "image_path", "left").join(have_mask, "mask_name", "left")
        .withColumn("status", F.when(F.col("_img").isNull(), "missing_image").when(F.col("_msk").isNull(), "missing_mask").otherwise("kept"))
        .withColumn("stem", F.concat(F.format_string("real_%06d_", "anchor_index"), naming.safe_name(naming.name_stem(F.col("mask_name")))))
        .withColumn("caption", prompts.render(template, token, descriptors, use_descriptors))
        .drop("_img", "_msk")
    )


def quarantine(dataset: DataFrame, bad: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Split off bad items: ``(clean, quarantined)``; a name already taken in quarantine gets ``__1``, ``__2``, ..."""
    clean = dataset.join(bad.select(key), key, "left_anti")
    taken = dataset.join(bad.select(key), key, "left_semi")
    numbered = sampling.with_position(taken, [key], "_i", by=[name])
    renamed = F.concat(naming.name_stem(F.col(name)), F.lit("__"), F.col("_i").cast("string"), naming.name_suffix(F.col(name)))
    return clean, numbered.withColumn("quarantine_name", F.when(F.col("_i") == 0, F.col(name)).otherwise(renamed)).drop("_i")

