"""Statistics of whole documents, counted in one pass over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tessella.llm.tables import texts
from tessella.llm.words import BYTE, Chunk, chunks, covered, hash_words, mix, per_doc, rolling, sliced, split_words, windows

#: What is counted, in the order of the columns.
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_wide", "n_short_lines", "n_bytes",
]
REPEAT = 5  # words of a window whose repetition counts
SHORT_LINE = 20  # bytes

_KINDS = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_digits": bytes(range(48, 58)),
    "n_marks": b".,;:!?",
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_MEMBER = {name: _table(chars) for name, chars in _KINDS.items()}


def _per_doc_keys(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same document."""
    return mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and document of each line; a text of n newlines has n + 1 lines."""
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.sort(np.concatenate([chunk.starts, breaks + 1]), kind="stable")
    stop = np.sort(np.concatenate([chunk.stops, breaks]), kind="stable")
    first = np.searchsorted(breaks, np.append(chunk.starts, len(chunk.data)))
    doc = np.repeat(np.arange(len(chunk)), np.diff(first) + 1)
    return start, stop, doc


def count_chunk(chunk: Chunk) -> dict[str, np.ndarray]:
    """All of ``COUNTS`` by document."""
    n, data = len(chunk), chunk.data
    cut = np.append(chunk.starts, len(data))
    out = {name: per_doc(member[data], cut) for name, member in _MEMBER.items()}
    out["n_bytes"] = np.diff(cut)
    words = split_words(chunk)
    hashes = hash_words(chunk, words)
    doc = words.doc
    out["n_words"] = words.counts
    lead = (data & 0xC0) != 0x80  # bytes that begin a code point
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    out["word_chars"] = np.bincount(doc, points[words.stop] - points[words.start], n).astype(np.int64)
    out["n_wide"] = per_doc(lead & (data >= 0x80), cut)
    _, one = np.unique(_per_doc_keys(hashes, doc), return_index=True)
    out["n_distinct_words"] = np.bincount(doc[one], minlength=n)
    start, stop, of = _lines(chunk)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_short_lines"] = np.bincount(of[stop - start < SHORT_LINE], minlength=n)
    worded = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    key, of = _per_doc_keys(sliced(rolling(BYTE[data]), start[worded], stop[worded]), of[worded]), of[worded]
    _, one = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[one], minlength=n)
    window, at, of = windows(words, hashes, REPEAT)
    _, group, size = np.unique(_per_doc_keys(window, of), return_inverse=True, return_counts=True)
    twice = covered(at[size[group] > 1], REPEAT, len(hashes))
    out["n_repeat_words"] = np.bincount(doc[twice], minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carried = [n for n in batch.schema.names if n != "text"]
        for chunk in chunks(batch.column("text")):
            found = count_chunk(chunk)
            kept = [batch.column(n).slice(chunk.first, len(chunk)) for n in carried]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found.values())], [*carried, *found])


def count_documents(docs: DataFrame, **carried: Column) -> DataFrame:
    """``doc_id``, the ``carried`` columns and ``COUNTS`` of each row of ``docs``; a null text counts as an empty one."""
    rows = texts(docs, **carried)
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_count, ", ".join([*schema, *(f"{c} long" for c in COUNTS)]))
