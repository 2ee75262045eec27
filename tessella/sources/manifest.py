"""Dataset manifests: nested file lists, totals and fetch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.naming import extension
from tessella.schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents: one row per document with a ``files`` array."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def flatten_manifest(manifest: DataFrame, extensions: Sequence[str] = ("jpg", "png")) -> DataFrame:
    """One row per file whose lower-cased extension is wanted (an empty list keeps all), names without a dot dropped.

    Not sorted: sort at the sink, where Spark range-partitions the output.
    """
    wanted = sorted({e.strip().lower().lstrip(".") for e in extensions if e.strip()})
    files = manifest.select(F.explode("files").alias("f"))
    ext = extension(F.col("f.filename"))
    keep = ext.isNotNull() if not wanted else ext.isin(wanted)
    return files.where(keep).select(
        F.col("f.filename").alias("filename"),
        F.col("f.id").alias("file_id"),
        F.col("f.content_details.download_url").alias("download_url"),
        F.col("f.content_details.view_url").alias("view_url"),
        F.col("f.content_details.sha256_hash").alias("sha256"),
        F.col("f.content_details.content_type").alias("content_type"),
        F.coalesce(F.col("f.content_details.size"), F.lit(0)).cast("bigint").alias("size_bytes"),
    )


def manifest_summary(files: DataFrame, first_n: int = 0) -> DataFrame:
    """File count and total size, of the first ``n`` files by name when a limit is given."""
    if first_n > 0:
        files = files.orderBy("filename").limit(first_n)
    return files.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes")
    )


def expect_version(manifest: DataFrame, expected: int) -> DataFrame:
    """The manifest, failing on execution when its version differs."""
    message = F.concat(F.lit(f"version mismatch: expected {expected}, got "), F.coalesce(F.col("version").cast("string"), F.lit("none")))
    ok = F.coalesce(F.col("version") == expected, F.lit(False))
    return manifest.where(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))  # a filter: no projection drops it


def fetch_plan(files: DataFrame, existing: DataFrame, skip_existing: bool = True) -> DataFrame:
    """Adds ``status``: ``missing_url``, ``skip`` (present, and size unknown or equal) or ``fetch``.

    ``existing`` is a listing ``(filename, length)``; without ``skip_existing`` everything with a URL is fetched.
    """
    present = existing.select("filename", F.col("length").alias("_length"))
    same = F.lit(skip_existing) & F.col("_length").isNotNull() & ((F.col("size_bytes") <= 0) | (F.col("_length") == F.col("size_bytes")))
    no_url = F.coalesce(F.col("download_url"), F.lit("")) == ""
    return (
        files.join(present, "filename", "left")
        .withColumn("status", F.when(no_url, "missing_url").when(same, "skip").otherwise("fetch"))
        .drop("_length")
    )
