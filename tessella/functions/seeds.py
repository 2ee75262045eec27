"""Deterministic seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_seed(base: int, source: Column, target: Column) -> Column:
    """Seed of one source and target."""
    return (F.lit(base) + source.cast("bigint") * 1000 + target.cast("bigint")).cast("bigint")


def class_seed(base: int, class_index: Column, repeat: Column) -> Column:
    """Seed of one class and repeat."""
    return (F.lit(base) + class_index.cast("bigint") * 10000 + repeat.cast("bigint")).cast("bigint")


def row_seed(base: int, row: Column) -> Column:
    """Seed of one edited row."""
    return (F.lit(base) + row.cast("bigint")).cast("bigint")


def image_seed(base: int, index: Column) -> Column:
    """Seed of one image."""
    return (F.lit(base) + index.cast("bigint") * 10007).cast("bigint")


def prompt_seed(mode: str, base: int, token_index: Column, prompt_index: Column) -> Column:
    """Seed of a preview prompt: one for all (``fixed``), one each (``per_class``) or none (``random``)."""
    if mode == "random":
        return F.lit(None).cast("bigint")
    if mode == "fixed":
        return F.lit(base).cast("bigint")
    return (F.lit(base) + token_index.cast("bigint") * 100 + prompt_index.cast("bigint")).cast("bigint")
