"""CSV relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """Fail at plan time when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required column(s): {', '.join(missing)}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that is a column."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} is a column of {df.columns}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A CSV relation with a header.

    Columns are found by header name and every cell is read as text, then cast tolerantly to the schema, so a
    reordered file or a bad cell never shifts or fails a load; columns the file lacks become NULL.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    require_columns(raw, required, path)
    if schema is None:
        return raw
    return raw.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in T.StructType.fromDDL(schema).fields
        ]
    )
