"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

1. Each task hashes all windows of its documents. Within a bounded buffer, equal windows are settled on the spot: all but those
   of the smallest ``doc_id`` are marked. What is left, at most one document per window and buffer, is dealt to buckets by
   hash: a window of a third of all documents still reaches its bucket only once per buffer.
2. A bucket marks the windows whose hash also occurs in a document with a smaller ``doc_id``.
3. The marks are gathered by document and merged into maximal intervals of words, which are then cut from the texts.

Rows between the steps are packed arrays, several thousand windows each; no step holds more than a buffer, a bucket or a
documents' share of marks. Two windows count as equal if their 64-bit hashes agree; n windows hold a false pair with a probability
of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import packed
from tessella.llm.tables import partitions, small, texts, written
from tessella.llm.words import chunks, hash_words, split_words, windows

WINDOW = 13
BUFFER = 2_000_000  # windows settled together before they are dealt


def _beaten(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries share their hash with a smaller document."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc[order], cut) if len(cut) else doc
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(cut, len(doc))))
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal runs of words to remove: ``doc_id, starts, stops`` (arrays), one row per document that has any.

    docs: ``doc_id`` and ``text``. Rows without a ``doc_id`` have no order among the others and take no part.
    """
    shares = partitions(docs.sparkSession)
    buckets = packed.BUCKETS * shares

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            hashes, doc, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            marked = _beaten(hashes, doc)
            yield from packed.pack(packed.by_document(doc[marked], shares), doc[marked], place[marked])
            hashes, doc, place = hashes[~marked], doc[~marked], place[~marked]
            yield from packed.pack(packed.by_hash(hashes, buckets), doc, place, hashes[None])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(chunk.first, len(chunk)).to_numpy(zero_copy_only=False)
                words = split_words(chunk)
                hashes, at, of = windows(words, hash_words(chunk, words), window)
                held.append((hashes, ids[of].astype(np.int64), at - words.first[of]))
                if sum(len(h) for h, _, _ in held) >= BUFFER:
                    yield from settle()
        if held:
            yield from settle()

    def mark(part: pa.Table) -> pa.Table:
        if part["bucket"][0].as_py() < 0:  # marks made before, already at their place
            return part
        doc, place, hashes = packed.unpack(part)
        marked = _beaten(hashes[0], doc)
        doc, place = doc[marked], place[marked]
        return packed.table(packed.pack(packed.by_document(doc, shares), doc, place))

    def merge(part: pa.Table) -> pa.Table:
        doc, place, _ = packed.unpack(part)
        return packed.runs(doc, place, place + window)

    hashed = texts(docs).where("doc_id IS NOT NULL").mapInArrow(hash_windows, packed.SCHEMA)
    marks = hashed.groupBy("bucket").applyInArrow(mark, packed.SCHEMA)
    return marks.groupBy("bucket").applyInArrow(merge, packed.RUNS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            rows = slice(chunk.first, chunk.first + len(chunk))
            words, data = split_words(chunk), chunk.data.tobytes()
            removed, kept_text = [], []
            runs = zip(batch.column("starts")[rows].to_pylist(), batch.column("stops")[rows].to_pylist())
            for i, (starts, stops) in enumerate(runs):
                a, b = int(words.first[i]), int(words.first[i + 1])
                keep = np.ones(b - a, bool)
                for start, stop in zip(starts or [], stops or []):
                    keep[start:stop] = False
                at = a + np.flatnonzero(keep)
                kept_text.append(b" ".join([data[x:y] for x, y in zip(words.start[at].tolist(), words.stop[at].tolist())]))
                removed.append(b - a - len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each row of ``docs``: every word is removed that lies in a window whose
    words also start, one after the other, in a document with a smaller ``doc_id``; the first document keeps all.

    Null texts have no words. Rows with the same ``doc_id`` are one document for this purpose: they don't remove each other's
    windows, and what one of them loses the others lose at the same places; rows without ``doc_id`` keep all. Further columns are
    ignored.
    """
    runs = written(repeated_windows(docs, window), "runs")
    runs = small(runs, 16 * F.size("starts"))
    joined = texts(docs).join(runs, "doc_id", "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(text: str):
    """SHA-256 of a text column, as lower-case hex digits."""
    return F.sha2(F.col(text).cast("binary"), 256)
