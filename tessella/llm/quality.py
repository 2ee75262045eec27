"""Quality classifier: boosted trees over document statistics.

The statistics come from one pass over all texts (``statistics.count_documents``). The trees are fitted on the statistics of a
bounded sample of labelled rows, ``SAMPLE`` rows of ``len(FEATURES)`` numbers at most, the rows with the smallest hash of their
``doc_id``; all else covers every document. The fitted forest is a few kilobytes of flat arrays and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.forest import Forest, train
from tessella.llm.statistics import COUNTS, count_chunk, count_documents
from tessella.llm.tables import written
from tessella.llm.words import chunks

#: Most labelled rows the trees are fitted on.
SAMPLE = 40_000

#: Shares rather than counts, so that the length of a text alone says little.
FEATURES = {
    "words": lambda c: np.log1p(c["n_words"]),
    "word_length": lambda c: c["word_chars"] / np.maximum(c["n_words"], 1),
    "symbols": lambda c: c["n_symbols"] / np.maximum(c["word_chars"], 1),
    "dup_lines": lambda c: c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
    "repeats": lambda c: c["n_repeat_words"] / np.maximum(c["n_words"], 1),
    "distinct": lambda c: c["n_distinct_words"] / np.maximum(c["n_words"], 1),
    "capitals": lambda c: c["n_upper"] / np.maximum(c["word_chars"], 1),
    "digits": lambda c: c["n_digits"] / np.maximum(c["word_chars"], 1),
    "marks": lambda c: c["n_marks"] / np.maximum(c["n_words"], 1),
    "wide": lambda c: c["n_wide"] / np.maximum(c["word_chars"], 1),
    "short_lines": lambda c: c["n_short_lines"] / np.maximum(c["n_lines"], 1),
    "line_words": lambda c: c["n_words"] / np.maximum(c["n_lines"], 1),
}


def fold(key: Column | str, folds: int) -> Column:
    """The fold of a key: the CRC-32 of its decimal text modulo ``folds``."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % folds).cast("int")


def _features(batch: pa.RecordBatch) -> np.ndarray:
    counts = {c: batch.column(c).to_numpy() for c in COUNTS}
    return np.stack([f(counts).astype(np.float64) for f in FEATURES.values()], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees for ``labels`` (``doc_id``, ``label``: 0 or 1). Rows with a null key or label take no part; of several labels
    of a document the largest counts, and of several rows of a document each is a training row."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    draw = F.xxhash64("doc_id")
    rows = stats.join(known, "doc_id").orderBy(draw, "doc_id", *COUNTS).limit(sample).select("label", *COUNTS).toArrow()
    batch = rows.combine_chunks().to_batches()
    if not batch:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(_features(batch[0]), batch[0].column("label").to_numpy().astype(np.float64))


def score_statistics(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``score``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(_features(batch)))], [*batch.schema.names, "score"])

    return stats.mapInArrow(score, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema), "score double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (1 if the score reaches the threshold) for each row of ``docs``.

    docs: ``doc_id`` and ``text``; labels: ``doc_id`` and ``label``. Null and empty texts have the statistics of no words and are
    scored like all others. Without labels of both kinds every score is the same. Further columns are ignored.
    """
    stats = written(count_documents(docs), "quality-stats")
    scored = score_statistics(stats, fit(stats, labels, sample))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold; each row is scored by its own text.

    The trees are fitted on the statistics of the sampled rows alone, whose ids (``sample`` at most) are broadcast; then one pass over
    all texts scores and filters, and nothing is shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    forest = fit(count_documents(wanted), chosen, sample)

    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            for chunk in chunks(text.cast(pa.large_string())):
                counts = count_chunk(chunk)
                table = pa.RecordBatch.from_arrays([pa.array(counts[c]) for c in COUNTS], COUNTS)
                yield batch.slice(chunk.first, len(chunk)).filter(pa.array(forest.score(_features(table)) >= threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # columns may have any names outside
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
