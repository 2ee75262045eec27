"""Names, paths, keys: pure column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(path: Column) -> Column:
    """Last path component; trailing slashes do not count."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def name_suffix(name: Column) -> Column:
    """Extension with its dot; empty for dot-files and names ending in a dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def name_stem(name: Column) -> Column:
    """Name without its extension."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def stem_key(path: Column) -> Column:
    """Lower-cased stem, the join key of images, masks and captions."""
    return F.lower(name_stem(path_name(path)))


def extension(name: Column) -> Column:
    """Lower-cased extension after the last dot; NULL without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def _volume_core(stem: Column) -> Column:
    return F.regexp_replace(stem, r"\)$", "")


_VOLUME = r"^(.*?)-(\d+)$"


def volume_id(stem: Column) -> Column:
    """Volume part of ``<volume>-<slice>``, keeping one closing bracket; the stem itself when it has no slice."""
    core = _volume_core(stem)
    base = F.regexp_extract(core, _VOLUME, 1)
    closed = F.when(stem.endswith(")") & ~base.endswith(")"), F.concat(base, F.lit(")"))).otherwise(base)
    return F.when(core.rlike(_VOLUME), closed).otherwise(stem)


def slice_index(stem: Column) -> Column:
    """Slice number after the last dash, -1 when absent."""
    core = _volume_core(stem)
    return F.when(core.rlike(_VOLUME), F.regexp_extract(core, _VOLUME, 2).cast("int")).otherwise(F.lit(-1))


def group_code(stem: Column) -> Column:
    """Group letter of ``(X1-2)``, else ``UNK``; only single digits count."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"\(([A-Z])\d-\d\)", 1), F.lit("")), F.lit("UNK"))


def safe_name(raw: Column, default: str = "item") -> Column:
    """Letters, digits, dash and underscore stay; the rest becomes ``_``; outer underscores go."""
    kept = F.regexp_replace(raw, r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit(default))


def mask_name(filename: Column, image_path: Column) -> Column:
    """Mask file name of a row: its file name, else the last component of the image path."""
    return F.coalesce(F.nullif(F.trim(filename), F.lit("")), path_name(image_path))


def source_key(index: Column, name: Column) -> Column:
    """``0007_<safe stem>``."""
    return F.concat(F.format_string("%04d", index), F.lit("_"), safe_name(name_stem(name), "image"))


def output_names(primary: Column, extra: Sequence[Column]) -> Column:
    """Primary name and the non-blank extra names, without repeats, in order."""
    trimmed = F.array(*[F.trim(c) for c in extra])
    return F.array_distinct(F.concat(F.array(primary), F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def model_alias(spec: Column) -> Column:
    """Part before the first ``=``; NULL when the spec is malformed."""
    return F.nullif(F.trim(F.regexp_extract(spec, r"^([^=]*)=(.*)$", 1)), F.lit(""))


def model_path(spec: Column) -> Column:
    """Part after the first ``=``; NULL when the spec is malformed."""
    return F.nullif(F.trim(F.regexp_extract(spec, r"^([^=]*)=(.*)$", 2)), F.lit(""))
