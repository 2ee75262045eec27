"""Joins of listings, metadata and task tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_status(rows: DataFrame) -> DataFrame:
    """Status of image rows left-joined with mask sizes: ``missing_mask``, ``size_mismatch`` or ``ok``."""
    return rows.withColumn(
        "status",
        F.when(F.col("mask_w").isNull(), "missing_mask")
        .when((F.col("w") != F.col("mask_w")) | (F.col("h") != F.col("mask_h")), "size_mismatch")
        .otherwise("ok"),
    )


def join_expected(names: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected label of each file name through the prompt index inside the name; NULL when out of range."""
    from tessella.functions.prompts import prompt_index

    return names.withColumn("prompt_index", prompt_index(F.col("name"))).join(expected, "prompt_index", "left")


def resolve_models(specs: DataFrame) -> DataFrame:
    """``alias=path`` specs with a status: ``ok``, ``invalid`` or ``duplicate``.

    Aliases are counted by an aggregate and joined back, so one alias in many rows is merged early.
    """
    from tessella.functions.naming import model_alias, model_path

    parsed = specs.withColumn("alias", model_alias(F.col("spec"))).withColumn("path", model_path(F.col("spec")))
    uses = parsed.where("alias IS NOT NULL").groupBy("alias").agg(F.count("*").alias("_uses"))
    return (
        parsed.join(uses, "alias", "left")
        .withColumn(
            "status",
            F.when(F.col("alias").isNull() | F.col("path").isNull(), "invalid").when(F.col("_uses") > 1, "duplicate").otherwise("ok"),
        )
        .drop("_uses")
    )


def models_or_legacy(resolved: DataFrame, legacy: DataFrame) -> DataFrame:
    """``alias, path`` of the resolved specs; where there are none, those of the ``legacy`` list (``position, alias, path``).

    A legacy path that is NULL, empty or ``null`` is skipped, and of a repeated alias the first position counts.  A spec that isn't ``ok``
    fails.
    """
    failed = F.raise_error(F.concat(F.lit("model spec "), F.col("status"), F.lit(": "), F.coalesce("alias", F.lit("no alias"))))
    given = resolved.where(F.when(F.col("status") == "ok", True).otherwise(failed.cast("boolean"))).select("alias", "path")
    usable = legacy.where("alias IS NOT NULL AND path IS NOT NULL AND path NOT IN ('', 'null')")
    first = usable.groupBy("alias").agg(F.min_by("path", "position").alias("path"))
    any_given = given.limit(1).select(F.lit(True).alias("_any"))  # one row at most
    return given.unionByName(first.join(F.broadcast(any_given), F.col("_any"), "left_anti"))


def pair_images(images: DataFrame, masks: DataFrame, classes: DataFrame, mode: str = "filename_group") -> DataFrame:
    """Image rows paired with masks of the same stem and labelled.

    ``images``: ``image_id, stem, image_path``; ``masks``: ``stem, mask_path``; ``classes``: ``image_id, classes_present,
    dominant_class_id``.
    """
    from tessella.functions import labels, naming

    rows = images.join(masks, "stem").join(classes, "image_id")
    group = naming.group_code(F.col("stem"))
    coarse = labels.coarse_by_group(group) if mode == "filename_group" else labels.coarse_by_classes(F.col("classes_present"))
    return rows.select(
        "image_id", "image_path", "mask_path", naming.path_name(F.col("image_path")).alias("filename"),
        naming.path_name(F.col("mask_path")).alias("mask_filename"), F.col("stem").alias("slice_id"), group.alias("group_code"),
        naming.volume_id(F.col("stem")).alias("volume_id"), naming.slice_index(F.col("stem")).alias("slice_index"),
        "classes_present", "dominant_class_id", labels.class_name(F.col("dominant_class_id")).alias("histology_label"),
        coarse.alias("coarse_label"), F.lit(mode).alias("coarse_label_source"),
    )


def first_existing(rows: DataFrame, key: str, candidates, listing: DataFrame, name: str) -> DataFrame:
    """Per row the first candidate name (array column) that the listing holds, as ``resolved`` (NULL if none)."""
    tried = rows.select(key, F.posexplode(candidates).alias("_order", name))
    hits = tried.join(listing.select(name).distinct(), name).groupBy(key).agg(F.min_by(name, "_order").alias("resolved"))
    return rows.join(hits, key, "left")


def mask_candidates(mask_filename, filename):
    """Mask names to try: the row's own, the image's, then the image stem with common extensions."""
    from tessella.functions.naming import name_stem

    stems = [F.concat(name_stem(filename), F.lit(e)) for e in (".jpg", ".png", ".jpeg")]
    return F.filter(F.array(mask_filename, filename, *stems), lambda x: x.isNotNull() & (x != ""))


def merge_metadata(edits: DataFrame, patches: DataFrame) -> DataFrame:
    """Edits joined with the patches they came from; shared columns get a suffix, except the label, which stays the patch's."""
    shared = [c for c in edits.columns if c in patches.columns and c != "slice_id"]
    left = edits.select(*[F.col(c).alias(f"{c}_edit" if c in shared else c) for c in edits.columns])
    right = patches.select(*[F.col(c).alias(f"{c}_extract" if c in shared and c != "coarse_label" else c) for c in patches.columns])
    return left.join(right, "slice_id")


def missing_report(rows: DataFrame, others: DataFrame, key: str, name: str, examples: int = 8) -> DataFrame:
    """How many rows lack a partner, and the first few names."""
    lost = rows.join(others, key, "left_anti")
    first = lost.select(name).orderBy(name).limit(examples).agg(F.array_sort(F.collect_list(name)).alias("examples"))
    return lost.agg(F.count("*").alias("n_missing")).withColumn("examples", first.scalar())


def label_chain(images: DataFrame, labels: DataFrame, tokens, default: str = "benign_lesion") -> DataFrame:
    """Token of an image stem: its own label, the label without ``real_``, the token named in ``synth_<token>``, the default.

    Both lookups use one join: the stem and its shortened form are tried as two candidates.
    """
    stem = F.col("stem")
    tries = F.filter(
        F.array(stem, F.when(stem.startswith("real_"), F.regexp_replace(stem, "^real_", ""))), lambda x: x.isNotNull()
    )
    asked = images.select("stem", F.posexplode(tries).alias("_order", "_key"))
    found = (
        asked.join(labels.select(F.col("stem").alias("_key"), "token"), "_key")
        .groupBy("stem")
        .agg(F.min_by("token", "_order").alias("_token"))
    )
    named = F.regexp_extract(stem, f"^synth_({'|'.join(tokens)})(?:_|$)", 1)
    return (
        images.join(found, "stem", "left")
        .withColumn("token", F.coalesce("_token", F.nullif(named, F.lit("")), F.lit(default)))
        .drop("_token")
    )


def link_anchors(images: DataFrame, captions: DataFrame, masks: DataFrame) -> DataFrame:
    """Images that have both a caption and a mask; of several masks the first by name."""
    first = masks.groupBy("stem").agg(F.min("mask_name").alias("mask_name"))
    return images.join(captions, "stem").join(first, "stem")


def mark_existing(planned: DataFrame, existing: DataFrame, key) -> DataFrame:
    """Planned work with ``reused_existing``: one left join instead of a semi and an anti join."""
    key = [key] if isinstance(key, str) else list(key)
    done = existing.select(*key).distinct().withColumn("reused_existing", F.lit(True))
    return planned.join(done, key, "left").withColumn("reused_existing", F.coalesce("reused_existing", F.lit(False)))


def task_grid(sources: DataFrame, tokens, models, seed_base: int = 42) -> DataFrame:
    """Sources x target labels x models. Labels and models are parameters, so the grid is an ``explode`` of a
    constant array: no join, no shuffle."""
    from tessella.functions import scores, seeds

    targets = F.array(*[F.struct(F.lit(i).alias("target_index"), F.lit(t).alias("target_label")) for i, t in enumerate(tokens)])
    grid = sources.withColumn("_t", F.explode(targets)).select("*", "_t.*").drop("_t")
    grid = grid.withColumn("model_alias", F.explode(F.array(*[F.lit(m) for m in models])))
    return grid.select(
        "*",
        scores.prompt_mode(F.col("source_label"), F.col("target_label")).alias("prompt_mode"),
        seeds.task_seed(seed_base, F.col("source_index"), F.col("target_index")).alias("seed"),
    )


def shared_sources(spark, path: str, make) -> DataFrame:
    """The sample every candidate is scored on: read when written before, else made once and written."""
    from tessella.sources.sinks import read_if_exists

    found = read_if_exists(spark, path)
    if found is None:
        make().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    if "source_index" not in found.columns:
        from tessella.operators.sampling import with_position

        found = with_position(found, found.columns, "source_index")
    return found
