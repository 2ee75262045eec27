"""Labels, classes and free-text categories."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class id -> name
CLASS_NAMES = {
    0: "background",
    1: "epidermis",
    2: "reticular_dermis",
    3: "papillary_dermis",
    4: "dermis",
    5: "keratin",
    6: "inflammation",
    7: "hair_follicles",
    8: "glands",
    9: "basal_cell_carcinoma",
    10: "squamous_cell_carcinoma",
    11: "intraepidermal_carcinoma",
}
# Classes that make a slide positive
POSITIVE_CLASSES = (9, 10, 11)
# Name group -> coarse label
GROUP_LABELS = {"A": "non_cancer", "B": "cancer", "C": "cancer", "D": "cancer"}
# Coarse tokens and the category table that leads to them
TOKENS = ("healthy", "benign_lesion", "opmd", "cancer")
CATEGORY_TOKENS = {
    "non_cancer": "non_cancer",
    "non cancer": "non_cancer",
    "healthy": "healthy",
    "benign_lesion": "benign_lesion",
    "benign lesion": "benign_lesion",
    "opmd": "opmd",
    "cancer": "cancer",
    "malignant": "cancer",
    "potentially_malignant": "opmd",
    "infectious": "benign_lesion",
    "reactive_inflammatory": "benign_lesion",
    "other": "benign_lesion",
    "Doenças infecciosas": "benign_lesion",
    "Lesões inflamatórias reativas": "benign_lesion",
    "Neoplasias malignas": "cancer",
    "Doenças potencialmente malignas": "opmd",
    "Outras": "benign_lesion",
}
# White space as Unicode text handling sees it: as a pattern range and as characters
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def literal_map(pairs: Mapping) -> Column:
    """A small constant map."""
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def lookup(key: Column, pairs: Mapping, default=None) -> Column:
    """Constant-map lookup with a default."""
    found = F.try_element_at(literal_map(pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default) if not isinstance(default, Column) else default)


def class_name(class_id: Column) -> Column:
    """Class name, ``class_<id>`` for ids outside the table."""
    return lookup(class_id, CLASS_NAMES, F.concat(F.lit("class_"), class_id.cast("string")))


def coarse_by_group(group: Column) -> Column:
    """Coarse label from the name group."""
    return lookup(group, GROUP_LABELS, "non_cancer")


def coarse_by_classes(classes: Column) -> Column:
    """Positive when any positive class is present."""
    hit = F.arrays_overlap(classes, F.array(*[F.lit(c) for c in POSITIVE_CLASSES]))
    return F.when(hit, "cancer").otherwise("non_cancer")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every character whose canonical decomposition starts with an ASCII character, and that character."""
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        flat = unicodedata.normalize("NFD", ch)
        if flat != ch and ord(flat[0]) < 0x80:
            source.append(ch)
            target.append(flat[0])
    return "".join(source), "".join(target)


def normalise_category(text: Column) -> Column:
    """Trim, drop accents and other non-ASCII characters, lower-case, collapse white space."""
    trimmed = F.trim(text, F.lit(SPACES))
    # one byte per character means there is nothing to translate
    flat = F.when(F.octet_length(trimmed) == F.char_length(trimmed), trimmed).otherwise(
        F.regexp_replace(F.translate(trimmed, *_accent_table()), r"[^\x00-\x7F]", "")
    )
    # single blanks are left alone: only runs that change are matched
    return F.regexp_replace(F.lower(flat), r"[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*| [\t-\r\x1c-\x20]+", " ")


def plain_category(text: str) -> str:
    """The same rule for one Python string."""
    flat = unicodedata.normalize("NFD", text.strip(SPACES)).encode("ascii", "ignore").decode("ascii").lower()
    return " ".join(flat.split())


def label_token(category: Column, table: Mapping[str, str] = CATEGORY_TOKENS, known: Sequence[str] = TOKENS, default: str = "benign_lesion") -> Column:
    """Token of a normalised category: table (its keys are normalised alike), else its underscored form when known, else the default."""
    coarse = F.replace(category, F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(category, {plain_category(k): v for k, v in table.items()}), F.when(coarse.isin(list(known)), coarse), F.lit(default))


def normalise_token(raw: Column, aliases: Mapping[str, str], known: Sequence[str], default: str | None = None) -> Column:
    """Case-folded token with underscores, passed through an alias table; unknown ones become the default,
    or stay as they are when there is none."""
    token = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))
    named = lookup(token, aliases, token) if aliases else token
    return named if default is None else F.when(named.isin(list(known)), named).otherwise(F.lit(default))


# Spellings of the edit mode
MODES = {"text2image": "text2image", "txt2img": "text2image", "inpaint": "inpaint", "inpainting": "inpaint"}


def normalise_mode(raw: Column, strict: bool = True) -> Column:
    """Edit mode without case, dashes and underscores; an unknown mode fails (or is NULL when not strict)."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(raw, F.lit("")), F.lit("text2image")))), "[-_]", "")
    found = lookup(plain, MODES)
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), raw)))


def binary_target(label: Column, positive: str = "cancer") -> Column:
    """1 for the positive label, else 0."""
    return F.coalesce((label == positive).cast("int"), F.lit(0))
