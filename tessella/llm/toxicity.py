"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its features: lower-cased words, pairs of neighbours and pairs around one word, each hashed to one of
``2 ** BITS`` positions. Every position has its own learning rate, which falls with the gradients it has seen, and the L1 term
keeps the weight of most positions at exactly zero. What is left is a short list of (position, weight), which travels with the tasks.

Learning goes example by example, so it takes a bounded sample of labelled rows, ``SAMPLE`` at most, in one task; features seen
in fewer than ``LEAST`` documents of the sample are left out there. Scoring covers every word of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import texts
from tessella.llm.words import Chunk, chunks, hash_words, mix, split_words

SAMPLE, EPOCHS, LEAST = 12_000, 4, 3
BITS = 22
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.01


def feature_positions(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Position and document of each feature of a chunk, repeats included."""
    words = split_words(chunk)
    one, doc = hash_words(chunk, words, lower=True), words.doc
    found, of = [one], [doc]
    for gap, salt in ((1, 0x51ED270B76C1D4F3), (2, 0x2545F4914F6CDD1D)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        left, right = one[: len(same)][same], one[gap:][same]
        found.append(mix(left * np.uint64(salt) + right))
        of.append(doc[: len(same)][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


@dataclass
class Weights:
    """The positions with a weight other than zero, ascending, and the constant term."""

    position: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, chunk: Chunk, dense: np.ndarray) -> np.ndarray:
        """Probability of label 1; each feature counts once a document. dense: all ``2 ** BITS`` weights."""
        position, doc = feature_positions(chunk)
        known = dense[position] != 0
        pair = np.unique((doc[known] << BITS) | position[known])
        total = self.bias + np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], len(chunk))
        return 1 / (1 + np.exp(-total))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.position] = self.weight
        return out


def learn(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, least: int = LEAST) -> tuple[np.ndarray, float]:
    """All weights and the constant after ``epochs`` passes over ``rows`` (distinct positions of each document)."""
    seen = np.zeros(1 << BITS, np.int32)
    for position in rows:
        seen[position] += 1
    rows = [position[seen[position] >= least] for position in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0  # the constant term is position -1 and isn't held back

    def weight(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for position, label in zip(rows, labels):
            at = np.append(position, len(z) - 1)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    every = weight(np.arange(len(z)))
    return every[:-1], float(every[-1])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            position, doc = feature_positions(chunk)
            pair = np.unique((doc << BITS) | position)
            cut = np.searchsorted(pair >> BITS, np.arange(len(chunk) + 1))
            low = (pair & ((1 << BITS) - 1)).astype(np.uint32)
            packed = pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            own = [batch.column(c).slice(chunk.first, len(chunk)) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*own, packed], ["doc_id", "label", "features"])


def _learn_sample(part: pa.Table) -> pa.Table:
    part = part.sort_by([("doc_id", "ascending"), ("features", "ascending")])
    order = np.random.default_rng(0).permutation(part.num_rows)
    packed, labels = part["features"].combine_chunks(), part["label"].to_numpy()[order].astype(np.float64)
    weights, bias = learn([np.frombuffer(packed[i].as_buffer(), np.uint32) for i in order.tolist()], labels)
    at = np.flatnonzero(weights)
    return pa.table({"position": pa.array(np.append(at, 1 << BITS), pa.int64()), "weight": np.append(weights[at], bias)})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights for ``labels`` (``doc_id``, ``label``: 0 or 1; of several the largest) of the sampled rows of ``docs``.

    The sampled ids are broadcast: ``sample`` rows at most. The weights that reach the driver are ``2 ** BITS`` at most.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Repeated rows of a sampled document must not lengthen the sample: one text of each id is learned from.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(_sample_features, "doc_id long, label int, features binary")
    once = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("features").alias("features"))
    table = once.groupBy(F.lit(0).alias("all")).applyInArrow(_learn_sample, "position long, weight double").toArrow().sort_by("position")
    position, weight = table["position"].to_numpy(), table["weight"].to_numpy()
    if len(position) == 0:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Weights(position[:-1], weight[:-1], float(weight[-1]))


def score_texts(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for each row of ``docs``; null and empty texts get the score of the constant term."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                own = batch.column("doc_id").slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([own, pa.array(weights.score(chunk, dense))], ["doc_id", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (1 if the score reaches the threshold) of every row of ``docs``.

    docs: ``doc_id`` and ``text``; labels: ``doc_id`` and ``label``. Repeated rows are scored one by one; further columns are
    ignored. Without labels every score is a half.
    """
    return score_texts(docs, fit(docs, labels, sample)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
