"""The two places where callers plug in a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.functions import scores
from tessella.operators.blocks import map_batches, parts, pixels


ROWS = 256  # rows of one model call at most; Arrow batches are bounded by bytes before that
_made: dict[str, Callable] = {}  # models of this Python worker


class PerWorker:
    """A model that every Python worker makes once and keeps for all its tasks: ``make(*local files) -> callable``.

    Tasks carry ``make`` alone. Weights are files in a store that the driver and all executors reach; Spark fetches each of them
    once per executor. Their names must differ.
    """

    def __init__(self, spark: SparkSession, make: Callable, files: Sequence[str] = ()):
        for f in files:
            spark.sparkContext.addFile(f)
        self.make, self.names = make, [PurePosixPath(f).name for f in files]
        self.key = hashlib.sha256(cloudpickle.dumps((make, list(files)))).hexdigest()

    def __call__(self, *args):
        if self.key not in _made:
            _made[self.key] = self.make(*(SparkFiles.get(n) for n in self.names))
        return _made[self.key](*args)


def _parts(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows].copy()


def batch_score(inputs: DataFrame, predict: Callable, classes: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Score rows in batches: ``predict(pandas batch) -> (rows, classes) logits``, a function or ``PerWorker``.

    Adds ``probs``, ``pred_label`` and ``confidence``; only the model call runs in Python.
    """
    schema = T.StructType([*inputs.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in _parts(batches, rows):
            batch["logits"] = list(np.asarray(predict(batch), dtype=np.float64))
            yield batch

    scored = inputs.mapInPandas(run, schema).withColumn("probs", scores.softmax(F.col("logits")))
    return scored.select(
        "*", scores.predicted(F.col("probs"), classes).alias("pred_label"), F.array_max("probs").alias("confidence")
    ).drop("logits")


def batch_edit(patches: DataFrame, edit: Callable, rows: int = ROWS) -> DataFrame:
    """Edit patches in batches: ``edit(images, masks, prompts, seeds) -> images`` of unchanged shapes; a function or ``PerWorker``.

    ``patches`` are single-block images with ``mask`` bytes, ``prompt`` and ``seed``; all columns but the mask are kept.
    """
    kept = [f for f in patches.schema.fields if f.name != "mask"]

    schema = T.StructType(kept)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in parts(whole, rows)):
            columns = batch.to_pydict()
            patches = [dict(zip(columns, row)) for row in zip(*columns.values())]
            masks = [np.frombuffer(r["mask"], dtype=np.uint8).reshape(r["h"], r["w"]) for r in patches]
            made = edit([pixels(r) for r in patches], masks, columns["prompt"], columns["seed"])
            columns["data"] = [np.ascontiguousarray(m, dtype=np.uint8).tobytes() for m in made]
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(patches, run, schema)
