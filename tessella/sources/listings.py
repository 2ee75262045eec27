"""Folder and checkpoint listings as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import naming
from tessella.functions.prompts import prompt_label
from tessella.operators.sampling import with_position

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp")
NATURAL = r"^(?:epoch-(\d+)|at-step(\d+)|(last))\.safetensors$"


def list_folder(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, filename, length, modificationTime`` of a folder; file contents are never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", "length", "modificationTime")
    return files.withColumn("filename", naming.path_name(F.col("path")))


def list_images(listing: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS, name: str = "filename",
                ties: Sequence[str] = ()) -> DataFrame:
    """Images of a listing in name order with a dense 0-based ``image_index``."""
    kept = listing.where(naming.extension(F.col(name)).isin(list(extensions)))
    return with_position(kept, [name, *ties], "image_index")


def natural_key(name: Column, steps: bool = True) -> Column:
    """Checkpoint order: epochs by number, steps by number, ``last``, then other names.

    With ``steps`` off, step checkpoints count as other names.
    """
    epoch = F.regexp_extract(name, NATURAL, 1)
    step = F.regexp_extract(name, NATURAL, 2) if steps else F.lit("")
    last = F.regexp_extract(name, NATURAL, 3)
    rank = F.when(epoch != "", 0).when(step != "", 1).when(last != "", 2).otherwise(3)
    number = F.coalesce(F.nullif(epoch, F.lit("")), F.nullif(step, F.lit(""))).try_cast("bigint")
    return F.struct(
        rank.alias("rank"),
        F.when(rank <= 1, number).otherwise(F.lit(0)).alias("number"),
        F.when(rank == 3, name).otherwise(F.lit("")).alias("name"),
    )


def checkpoints(listing: DataFrame, run: str, name: str, include_last: bool = True, latest: int = 0,
                ties: Sequence[str] = (), steps: bool = True) -> DataFrame:
    """Checkpoints of each run in natural order (``position`` from 0), only the latest N when asked.

    The latest N are found by a ranked window from the far end, so only N rows per run and task move.
    """
    rows = listing if include_last else listing.where(F.col(name) != "last.safetensors")
    rows = rows.withColumn("_key", natural_key(F.col(name), steps))
    if latest > 0:
        back = Window.partitionBy(run).orderBy(F.desc("_key"), *[F.desc(t) for t in ties])
        rows = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= latest).drop("_back")
    return with_position(rows, ["_key", *ties], by=[run]).drop("_key")


def checkpoints_by_time(listing: DataFrame, run: str, name: str, mtime: str, include_last: bool = False) -> DataFrame:
    """Checkpoints by (time, name); ``last`` is dropped only where a run has others."""
    if not include_last:
        others = listing.where(F.col(name) != "last.safetensors").select(run).distinct().withColumn("_others", F.lit(True))
        rows = listing.join(others, run, "left").where((F.col(name) != "last.safetensors") | F.col("_others").isNull()).drop("_others")
    else:
        rows = listing
    return with_position(rows, [mtime, name], by=[run])


def explicit_checkpoints(requests: DataFrame, listing: DataFrame, run: str, names: str, name: str, strict: bool = True) -> DataFrame:
    """Comma lists of names resolved against a listing, in list order; a missing name fails (or is flagged)."""
    asked = requests.select("*", F.posexplode(F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")).alias("position", "wanted"))
    have = listing.select(F.col(run), F.col(name).alias("wanted")).distinct().withColumn("found", F.lit(True))
    out = asked.join(have, [run, "wanted"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        failed = F.raise_error(F.concat(F.lit("checkpoint not found: "), F.col("wanted"))).cast("boolean")
        out = out.where(F.when(F.col("found"), True).otherwise(failed))  # a filter: no projection drops it
    return out


def prompt_labels(prompts: DataFrame, text: str) -> DataFrame:
    """Label of each prompt line of a file; blank and ``#`` lines do not count towards ``prompt_index``.

    The index is the position in the filtered line array, so no window is needed.
    """
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return prompts.select("*", F.posexplode(kept).alias("prompt_index", "line")).withColumn("label", prompt_label(F.col("line")))
