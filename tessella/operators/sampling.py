"""Exact seeded sampling, splitting and drawing that never puts a whole group into one task.

A random choice of exactly ``n`` rows is "the n smallest md5 draws".  Small caps over many groups use a
ranked window (Spark cuts each group to ``n`` on the map side).  Large or unbounded ``n`` uses
:func:`hash_rank`: draws are uniform, so a prefix of the digest splits even one huge group into equal
buckets; bucket sizes give the offset, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.tiles import draw_key
from tessella.session import pin

PREFIX = 3  # hex digits: 4096 buckets per group
FEW = 100_000  # asked rows up to which a ranked window (or a top-n) beats counting buckets: one pass over the input


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group columns with NULL as a group of its own; the right side's other columns are added."""
    named = right.select(*[F.col(c).alias(f"_group_{c}" if c in by else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in by]
    return left.join(named, reduce(and_, same), how).drop(*[f"_group_{c}" for c in by])


def hash_rank(df: DataFrame, draw: Column, by: Sequence[str] = (), ties: Sequence[str] = (), name: str = "rank",
              first: int | None = None, prefix: int = PREFIX) -> DataFrame:
    """Exact 0-based rank by draw within each group of ``by`` (few groups), without sorting a whole group.

    With ``first``, only ranks below it are kept. Up to ``FEW`` of them come from one pass: each task cuts its groups (or its
    rows) to that many. Beyond, buckets past the last rank fall away before anything is sorted. NULL is a group.
    """
    by = list(by)
    if first is not None and first <= FEW:
        drawn = df.withColumn("_draw", draw)
        if not by:
            drawn = drawn.orderBy("_draw", *ties).limit(first)  # each task sends its first rows only
        # the bare row number is compared: Spark doesn't see a limit per group through "row number - 1"
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", *ties))
        kept = drawn.withColumn("_row", rank).where(F.col("_row") <= first)
        return kept.select(*df.columns, (F.col("_row") - 1).alias(name))
    keyed = df.withColumn("_draw", draw).withColumn("_bucket", F.substring("_draw", 1, prefix))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    # at most 16 ** prefix rows per group
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_size")
    offsets = sizes.withColumn("_before", before).drop("_size")
    if first is not None:
        offsets = offsets.where(F.col("_before") < first)
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_draw", *ties)) - 1
    ranked = join_groups(keyed, offsets, [*by, "_bucket"]).select(*df.columns, (F.col("_before") + inside).alias(name))
    return ranked if first is None else ranked.where(F.col(name) < first)


def exact_sample(df: DataFrame, n: int, seed, key: Sequence[str]) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, seeded; ``n <= 0`` keeps all."""
    return df if n <= 0 else hash_rank(df, draw_key(seed, *key), ties=key, name="_rank", first=n).drop("_rank")


def stratified_sample(df: DataFrame, label: str, n: int, seed, key: Sequence[str], tokens: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows per label, NULL being one; ``n <= 0`` keeps all. With ``tokens``, other labels and NULL are dropped."""
    if tokens is not None:
        df = df.where(F.col(label).isin(list(tokens)))
    if n <= 0:
        return df
    return hash_rank(df, draw_key(seed, label, *key), by=[label], ties=key, name="_rank", first=n).drop("_rank")


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position", start: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Dense position by a total order, over all rows or within each group of ``by``.

    Rows are range-partitioned by group and order, so a group of any size is split over partitions; each partition is
    ranked on its own and the sizes of earlier partitions give the offset.  The partitioned rows are pinned so that both
    passes see the same split.
    """
    order, by = list(order), list(by)
    ranged = pin(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    # one row per group and partition it touches
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size")
    offsets = sizes.select(*by, "_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    place = (F.col("_before") + inside + F.lit(start)).cast("bigint")
    return join_groups(ranged, offsets, [*by, "_part"]).select(*df.columns, place.alias(name))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by the given total order. Plain aggregation, so duplicates of a hot key
    are merged before the shuffle."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by the given total order."""
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def group_split(df: DataFrame, group: str, fraction: float, seed) -> DataFrame:
    """Leakage-free split: adds ``split``; ``ceil(fraction * groups)`` whole groups go to validation."""
    groups = df.select(group).distinct()
    n_val = groups.agg(F.ceil(F.lit(fraction) * F.count("*"))).scalar()
    ranked = hash_rank(groups, draw_key(seed, group), ties=[group], name="_rank")
    return join_groups(df, ranked.select(group, F.when(F.col("_rank") < n_val, "val").otherwise("train").alias("split")), [group])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequency per class."""
    return df.groupBy(label).agg(F.count("*").alias("n"), (F.lit(1.0) / F.count("*")).alias("weight"))


def uniform(draw: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 digest: as fine as a double, so every row can be drawn."""
    return F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def weighted_draw(df: DataFrame, label: str, n: int | None, seed, key: Sequence[str]) -> DataFrame:
    """``n`` draws (as many as rows when ``None``) with replacement, every class equally likely and rows equally likely within a class.

    Inverse-frequency weights give each class the same mass, so a draw is "a class, then a position in it":
    an equi-join instead of a range join.
    """
    spark = df.sparkSession
    rows = hash_rank(df, draw_key(seed, label, *key), by=[label], ties=key, name="_pos")
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    by_label = Window.orderBy(label)
    classes = sizes.select(label, "_size", (F.row_number().over(by_label) - 1).alias("_class"))  # one row per class
    draws = spark.range(df.count() if n is None else n).withColumnRenamed("id", "draw")
    u1 = uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("class"), F.col("draw"))))
    u2 = uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("row"), F.col("draw"))))
    drawn = (
        draws.withColumn("_class", F.floor(u1 * classes.agg(F.count("*")).scalar()).cast("int"))
        .join(F.broadcast(classes), "_class")  # one row per class
        .withColumn("_pos", F.floor(u2 * F.col("_size")))
    )
    return join_groups(drawn, rows, [label, "_pos"]).drop("_pos", "_class", "_size")


def ordered_strata(df: DataFrame, label: str, n: int, seed, key: Sequence[str], name: str = "source_index") -> DataFrame:
    """Stratified sample with a dense 0-based index: labels in order, draws in order within a label.

    The index is "rows of earlier labels plus rank in the label", so no window spans the sample.
    """
    kept = hash_rank(df, draw_key(seed, label, *key), by=[label], ties=key, name="_rank", first=n if n > 0 else None)
    sizes = df.groupBy(label).agg(F.count("*").alias("_all"))
    size = F.least(F.col("_all"), F.lit(n)) if n > 0 else F.col("_all")
    # one row per label
    offsets = sizes.select(label, (F.sum(size).over(Window.orderBy(label)) - size).alias("_offset"))
    return join_groups(kept, offsets, [label]).select(*df.columns, (F.col("_offset") + F.col("_rank")).cast("bigint").alias(name))


def holdout_sample(df: DataFrame, selection: DataFrame, label: str, n: int, seed, key: Sequence[str]) -> DataFrame:
    """A second balanced sample, from rows the selection did not take."""
    return stratified_sample(df.join(selection.select(*key), list(key), "left_anti"), label, n, seed, key)


def holdout_overlap(selection: DataFrame, holdout: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows each sample has and how many keys they share (none, if the hold-out was drawn as above)."""
    shared = holdout.join(selection.select(*key).distinct(), list(key), "left_semi").agg(F.count("*").alias("n_overlap"))
    return selection.agg(F.count("*").alias("n_selection")).crossJoin(holdout.agg(F.count("*").alias("n_holdout"))).crossJoin(shared)  # one row each


def split_groups(split: DataFrame, group: str) -> DataFrame:
    """The groups of each side, with their rows."""
    return split.groupBy("split", group).agg(F.count("*").alias("n_rows"))


def split_report(split: DataFrame, group: str) -> DataFrame:
    """Rows and groups per side; the groups themselves stay a relation (``split, group``)."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.min(group).alias("first_group"), F.max(group).alias("last_group")
    )


def split_summary(split: DataFrame, group: str, history: DataFrame, metric: str = "val_f1") -> DataFrame:
    """One row: rows and groups of each side (0 for an absent one), and the best value of ``metric`` in the training history; the best starts
    at -1, and values that are missing or not numbers never improve it."""
    side = lambda name: F.col("split") == name
    counts = [F.count_if(side(n)).alias(f"{n}_rows") for n in ("train", "val")] + [F.count_distinct(F.when(side(n), F.col(group))).alias(f"{n}_groups") for n in ("train", "val")]
    best = history.agg(F.greatest(F.lit(-1.0), F.max(F.when(~F.isnan(metric), F.col(metric).cast("double")))).alias(f"best_{metric}"))
    return split.agg(*counts).crossJoin(best)  # one row each
