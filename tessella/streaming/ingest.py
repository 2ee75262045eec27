"""Incremental, restart-safe ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.sampling import keep_first
from tessella.sources.sinks import append_new

BUCKETS = 64


def stream_files(spark: SparkSession, path: str, schema, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream; ``per_batch`` bounds the files of one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append every row with a new key to ``target`` once, then stop.

    The checkpoint remembers finished files; the anti-join makes a batch that is replayed after a failure harmless.
    Within a batch the first row per key wins. The target is partitioned by a hash of the key into ``buckets``, of which a batch reads
    those that its keys fall into; ``sources.sinks.read_appended`` reads it without that column.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_new(keep_first(batch, key, order), target, key, buckets=buckets)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
