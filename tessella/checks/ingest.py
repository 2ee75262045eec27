"""Streaming ingest and image scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.checks import fixtures as fx
from tessella.checks.png import write_pngs
from tessella.checks.registry import check, table
from tessella.checks.roi import digest_sql
from tessella.operators.blocks import digest_shares, digest_sums
from tessella.session import new_path
from tessella.sources.images import scan_and_report, scan_images, to_grey
from tessella.sources.sinks import read_appended
from tessella.streaming.ingest import ingest_new, stream_files


@check("stream_ingest", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stream_ingest(spark, sf):
    """Two runs over the same folder: the second one adds nothing."""
    target, state = new_path(spark, "ingested"), new_path(spark, "state")
    schema = table(spark, sf, "orders").schema
    for _ in range(2):
        ingest_new(stream_files(spark, sf, schema, "orders.parquet"), target, state, ["o_orderkey"], ["o_orderdate", "o_custkey"])
    return read_appended(spark, target).select("o_orderkey", "o_custkey", "o_totalprice")


@check("image_scan", f"WITH {fx.PIXELS_SQL}, d AS ({digest_sql('pixels')}), g AS (SELECT k, CAST(sum((19595 * r + 38470 * g + 7471 * b + 32768) // 65536) AS BIGINT) AS grey FROM pixels GROUP BY k) SELECT d.*, grey FROM d JOIN g USING (k)")
def image_scan(spark, sf):
    """Slides written as PNG files, decoded again once; values in colour and in grey."""
    folders = write_pngs(fx.rgb_blocks(spark, sf, 512), new_path(spark, "png"))
    kernel, fields = digest_shares(more={"grey": lambda rgb: to_grey(rgb).sum(dtype=np.int64)})
    scanned = digest_sums(scan_images(spark, folders, "rgb", 32, kernel=kernel, fields=fields))
    return scanned.withColumn("image_id", F.regexp_extract("image_id", r"^(\d+)\.png$", 1).cast("int")).withColumnRenamed("image_id", "k")


@check("image_rejects", f"WITH {fx.SLIDES_SQL} SELECT count(*) AS readable, 1::BIGINT AS unreadable FROM slides")
def image_rejects(spark, sf):
    """A folder of slides and one broken file: what is read, and what is reported."""
    path = new_path(spark, "png")
    folders = [*write_pngs(fx.rgb_blocks(spark, sf, 512), path), f"{path}/other"]
    spark.range(1).select(F.lit("no image").alias("value")).coalesce(1).write.text(folders[-1])
    blocks, rejects = scan_and_report(spark, folders, "grey", 512)
    readable = blocks.agg(F.count_distinct("image_id").alias("readable"))
    return readable.crossJoin(rejects.agg(F.count("*").alias("unreadable")))  # one row each
