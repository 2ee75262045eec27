"""Class probabilities, margins and rewards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.labels import lookup


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda v: v / total)


def predicted(probs: Column, classes: Sequence[str]) -> Column:
    """Label of the first largest probability."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(probs, F.array_max(probs)).cast("int"))


def probability_of(probs: Column, label: Column, classes: Sequence[str]) -> Column:
    """Probability of a label, NULL for an unknown label."""
    place = lookup(label, {c: i + 1 for i, c in enumerate(classes)})
    return F.when(place.isNotNull(), F.try_element_at(probs, place))


def margin(source_label: Column, target_label: Column, source_prob: Column, target_prob: Column) -> Column:
    """Target minus source probability; NULL for same-class tasks or unknown labels."""
    return F.when(source_label != target_label, target_prob - source_prob)


def prompt_mode(source_label: Column, target_label: Column) -> Column:
    return F.when(source_label == target_label, "same_class").otherwise("cross_class")


def task_parameter(source_label: Column, target_label: Column, same: float, cross: float, per_target: Mapping[str, float]) -> Column:
    """Same-class value, else the target's own value, else the cross-class default."""
    own = lookup(target_label, per_target, float(cross)) if per_target else F.lit(float(cross))
    return F.when(source_label == target_label, F.lit(float(same))).otherwise(own)
