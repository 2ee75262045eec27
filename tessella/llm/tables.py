"""Tables of the input, intermediate tables in the shared folder, and joins whose small side is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import configure, new_path

#: A side is broadcast only if its measured rows and bytes stay below these; otherwise both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators: Arrow batches are bounded by bytes, because one text may be very long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, **carried: Column) -> DataFrame:
    """The key, the text and ``carried``; every other column, whatever its name, stays out of the operators."""
    more = [c.alias(name) for name, c in carried.items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many marks before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later passes read the same rows, also after executors are lost."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def measured(df: DataFrame, *sizes: Column | str) -> tuple[int, int]:
    """Rows and bytes (8 a row and column, plus ``sizes`` summed) of a written table."""
    extra = sum((F.coalesce(F.sum(s), F.lit(0)) for s in sizes), F.lit(0))
    rows, more = df.agg(F.count(F.lit(1)), extra.cast("long")).first()
    return rows, rows * 8 * len(df.columns) + more


def small(df: DataFrame, *sizes: Column | str) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is below the bound; unchanged, for a shuffled join, if not."""
    rows, size = measured(df, *sizes)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which a cluster is told how much data a job moves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
