"""Tolerant casts: empty, ``null``, NaN and garbage all become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_float(raw: Column, default: float | None = None) -> Column:
    """Number or NULL, or the default."""
    value = F.when(raw.cast("string").rlike(_NUMBER), raw.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def to_int(raw: Column, default: int | None = None) -> Column:
    """Whole number, truncating a fraction; NULL or the default otherwise."""
    value = to_float(raw).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def float_map(json: Column) -> Column:
    """JSON object, or a dictionary literal, as ``map<string,double>``; quoted numbers and truth values count, malformed text fails."""
    found = text_map(json)

    def number(key: Column, value: Column) -> Column:
        read = _once(F.lower(F.trim(value)), lambda plain: F.when(plain == "true", 1.0).when(plain == "false", 0.0).otherwise(plain.try_cast("double")))
        return F.coalesce(read, F.raise_error(F.concat(F.lit("not a number: "), key)).cast("double"))

    return F.transform_values(found, number)


def repeat_map(json: Column) -> Column:
    """JSON object as ``map<string,int>`` with negative numbers raised to zero."""
    return F.transform_values(float_map(json), lambda _, v: F.greatest(F.lit(0), v.cast("int")))


#: Spellings of a dictionary literal that a JSON parser doesn't take: constants, bare numbers as keys, a comma before the end, numbers
#: that begin or end with a point.
_LITERALS = (
    (r"([:,{]\s*)True(?=\s*[,}])", "$1true"), (r"([:,{]\s*)False(?=\s*[,}])", "$1false"), (r"([:,{]\s*)None(?=\s*[,}])", "$1null"),
    (r",\s*\}$", "}"), (r"([{,]\s*)([+-]?[0-9.]+)(?=\s*:)", "$1\"$2\""), (r"([:]\s*-?)\+?\.(?=[0-9])", "$10."), (r"(:\s*[+-]?[0-9]+)\.(?=\s*[,}])", "$1"),
)


def text_map(json: Column) -> Column:
    """JSON object as ``map<string,string>``; text that is none is read as a dictionary literal. Anything else fails."""
    kind = "map<string,string>"

    def checked(text: Column, found: Column) -> Column:
        trimmed = F.trim(text)
        wrong = found.isNull() | ~trimmed.startswith("{")
        failed = F.raise_error(F.concat(F.lit("not a JSON object: "), text)).cast(kind)
        return F.when(text.isNull() | (trimmed == ""), F.lit(None).cast(kind)).when(wrong, failed).otherwise(found)

    def literal(text: Column) -> Column:
        relaxed = F.trim(text)
        for pattern, to in _LITERALS:
            relaxed = F.regexp_replace(relaxed, pattern, to)
        return _once(relaxed, lambda r: _once(F.from_json(r, kind), lambda found: checked(r, found)))

    # the rewriting is tried only on texts that aren't JSON, and each step is named once: repeated, they multiply with every map on top
    return _once(json, lambda text: _once(F.from_json(text, kind), lambda found: F.when(found.isNull(), literal(text)).otherwise(checked(text, found))))


def id_list(text: Column) -> Column:
    """Distinct whole numbers of a comma list; blanks are skipped."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: x.cast("int")))
