"""Outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with a header in a global order (range-partitioned, one sorted file per partition)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON document from a one-row table."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet dataset, or ``None`` when it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


BUCKET = "key_bucket_"  # a partition column of this name and the number of buckets


def _buckets(df: DataFrame) -> int:
    """Into how many buckets of keys a dataset is partitioned; 0 if it isn't."""
    return next((int(c.removeprefix(BUCKET)) for c in df.columns if c.startswith(BUCKET)), 0)


def _bucketed(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(f"{BUCKET}{buckets}", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def unwritten(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Those of ``rows`` whose key ``existing`` lacks; NULL is a key like any other.

    Of a dataset in buckets only the partitions that rows fall into are read: their numbers, as many as there are buckets at most,
    become a partition filter of the scan.
    """
    buckets = _buckets(existing)
    if buckets:
        name = f"{BUCKET}{buckets}"
        rows = _bucketed(rows, key, buckets)
        existing = existing.where(F.col(name).isin([r[0] for r in rows.select(name).distinct().collect()]))
    known = existing.select(*(F.col(k).alias(f"_known_{i}") for i, k in enumerate(key)))
    same = [F.col(k).eqNullSafe(F.col(f"_known_{i}")) for i, k in enumerate(key)]
    return rows.join(known, same, "left_anti")


def append_new(df: DataFrame, path: str, key: Sequence[str], overwrite: bool = False, buckets: int = 0) -> None:
    """Write a dataset keeping what is already there: only rows with new keys are appended.

    buckets: a new dataset is partitioned by a hash of its key into so many; later batches follow the dataset's own number. A batch
    reads the buckets that its keys fall into, so small batches call for more buckets than they have rows, and large ones for few.
    """
    existing = None if overwrite else read_if_exists(df.sparkSession, path)
    if existing is None:
        fresh, mode = _bucketed(df, key, buckets) if buckets else df, "overwrite"
    else:
        fresh, mode, buckets = unwritten(df, existing, key), "append", _buckets(existing)
    if not buckets:
        fresh.write.mode(mode).parquet(path)
        return
    name = f"{BUCKET}{buckets}"
    # One file for each bucket and batch, unless a bucket is so large that it is split.
    fresh.hint("rebalance", F.col(name)).write.mode(mode).partitionBy(name).parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_new`` has written, without the number of its bucket."""
    rows = spark.read.parquet(path)
    return rows.drop(*(c for c in rows.columns if c.startswith(BUCKET)))


def write_block_table(blocks: DataFrame, name: str, buckets: int) -> None:
    """A table of blocks bucketed and sorted by ``image_id, by, bx``: aligned relations of as many buckets (an original and its edit) are joined
    without moving pixels. Blocks of one image spread over all buckets."""
    key = ["image_id", "by", "bx"]
    # Dealt like the buckets, so that each of them is one file.
    blocks.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of a schema, in order; absent ones are NULL, and a column the schema lacks is an error."""
    unknown = [c for c in df.columns if c not in T.StructType.fromDDL(schema).names]
    if unknown:
        raise ValueError(f"not in the schema: {unknown}")
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields]
    )


def append_history(history: DataFrame, rows: DataFrame, schema: str) -> DataFrame:
    """History with further rows, on a fixed column list."""
    return conform(history.unionByName(rows, allowMissingColumns=True), schema)
