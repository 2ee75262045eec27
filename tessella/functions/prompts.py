"""Prompts, captions and the labels inside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.labels import SPACE, SPACES, lookup
from tessella.functions.naming import name_stem

LABEL_IN_TEXT = r"(?i)(?:diagnosis|tissue\s*pattern):\s*([A-Za-z0-9_]+)"


def render(template: Column | str, token: Column, descriptors: Mapping[str, str], use_descriptors: bool = True) -> Column:
    """Fill ``{token}``, ``{descriptor}`` and ``{descriptor_suffix}``; the suffix is ``", <descriptor>"`` or empty."""
    text = F.lit(template) if isinstance(template, str) else template
    descriptor = F.trim(lookup(token, descriptors, "")) if descriptors else F.lit("")
    suffix = F.when(F.lit(use_descriptors) & (descriptor != ""), F.concat(F.lit(", "), descriptor)).otherwise("")
    for name, value in (("{token}", token), ("{descriptor}", descriptor), ("{descriptor_suffix}", suffix)):
        text = F.replace(text, F.lit(name), value)
    return F.trim(text)


def caption_token(text: Column, default: str = "benign_lesion") -> Column:
    """Label named in a caption, else its last word, else the default."""
    named = F.regexp_extract(text, LABEL_IN_TEXT, 1)
    last = F.regexp_extract(F.rtrim(text, F.lit(SPACES)), f"(?s)(?:^|.*[{SPACE}])([^{SPACE}]+)\\z", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(last, F.lit("")), F.lit(default))


def prompt_label(line: Column) -> Column:
    """Label named in a prompt line, empty when there is none."""
    return F.regexp_extract(line, LABEL_IN_TEXT, 1)


def prompt_index(name: Column) -> Column:
    """Second ``_`` part of the stem when it is all digits."""
    part = F.try_element_at(F.split(name_stem(name), "_"), F.lit(2))
    return F.when(part.rlike(r"^\d+$"), part.try_cast("int"))


def templates_for(token: Column, custom: Mapping[str, Sequence[str]], templates: Sequence[str], repeats: int) -> Column:
    """Templates of a token: its own list when it has one, else the common ones cycled ``repeats`` times."""
    cycled = F.array(*[F.lit(templates[i % len(templates)]) for i in range(repeats)])
    if not custom:
        return cycled
    own = F.create_map(*[c for k, v in custom.items() for c in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.try_element_at(own, token), cycled)


def prompt_line(prompt: Column, suffixes: Sequence[str], seed: Column | None) -> Column:
    """Prompt, its option suffixes and its seed as one line."""
    parts = [prompt, *[F.lit(s) for s in suffixes]]
    if seed is not None:
        parts.append(F.when(seed.isNotNull(), F.concat(F.lit("--d "), seed.cast("string"))))
    return F.concat_ws(" ", *parts)
