"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``DEPTH`` bytes, by two most-significant-digit passes over hashed digits; what is still
equal then is exactly a repeated window, and what is alone after a digit leaves. Suffixes are sorted in blocks of ``STEP``
neighbours, which share most of their bytes:

* Blocks are cut alike wherever the text is the same. The anchor of a window is the position in it of its smallest hash of
  ``GRAM`` bytes; a window starts a certain distance before its anchor, and the windows at ``STEP`` successive distances are a block.
* The first digit is the ``DEPTH - STEP + 1`` bytes that all windows of a block have in common. A block whose digit occurs nowhere
  else holds no repeated window: most blocks end here.
* Blocks that agree in all bytes that any of their windows covers are repeated as a whole.
* Of the blocks left, at the ends of repeated passages, the single windows are sorted by the second digit, all ``DEPTH`` bytes.

Equal entries are settled first within a task's buffer, and only one of them goes on to its bucket, so that a passage of
very many documents never gathers in one task. Marked bytes are gathered by document and merged into maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import packed
from tessella.llm.tables import partitions, small, texts, written
from tessella.llm.words import BYTE, Chunk, chunks, mix, rolling, sliced

DEPTH, STEP, GRAM = 400, 50, 51
BUFFER = 400_000  # blocks or windows settled together before they are dealt
_PLACE = np.uint64((1 << 31) - 1)
PLAIN, WHOLE, ASKED = 0, 1, 2  # of a block that goes on: new; repeated as a whole already; its windows are being sorted already


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values, by running minima from both ends of pieces of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def blocks(chunk: Chunk, depth: int, step: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First digit, hash of all bytes, document and place of each block of a chunk. A block at place c holds the windows that start
    from ``c - step + 1`` to ``c``. A block that reaches over its document's ends has no bytes to compare as a whole."""
    width = depth - gram + 1
    sizes = chunk.stops - chunk.starts
    if not (sizes >= depth).any():
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    prefix = rolling(BYTE[chunk.data])
    at = np.arange(len(chunk.data) - gram + 1)
    order = (sliced(prefix, at, at + gram) & ~_PLACE) | at.astype(np.uint64)
    anchor = (window_minima(order, width) & _PLACE).astype(np.int64)  # of the window at each position
    counts = np.maximum(sizes - depth + 1, 0)
    doc = np.repeat(np.arange(len(chunk)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + chunk.starts[doc]
    block = (anchor[start] - start) // step
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[start[1:]] != anchor[start[:-1]]) | (block[1:] != block[:-1])
    start, doc, block = start[new], doc[new], block[new]
    place = anchor[start] - block * step
    first = sliced(prefix, place, place + depth - step + 1) + block.astype(np.uint64)
    low, high = place - step + 1, place + depth
    inside = (low >= chunk.starts[doc]) & (high <= chunk.stops[doc])
    whole = sliced(prefix, np.where(inside, low, 0), np.where(inside, high, 0))
    return mix(first), np.where(inside, whole, np.uint64(0)), doc, place - chunk.starts[doc]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and the number of each entry's group of equal keys in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _settle_blocks(first: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray, state: np.ndarray):
    """Of blocks met together: which are repeated as a whole, which must sort their windows, and one of each first digit to go on
    with its new state (-1 for the others)."""
    n = len(first)
    repeated, asked, onward = np.zeros(n, bool), np.zeros(n, bool), state.copy()
    order = np.argsort(first)
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    size = np.diff(np.append(np.flatnonzero(new), n))
    many = order[np.repeat(size, size) > 1]  # few blocks share their digit; the rest goes on as it is
    if not len(many):
        return repeated, asked, onward
    order, same = _groups(first[many], doc[many], place[many])
    one = np.ones(len(order), bool)
    one[1:] = same[1:] != same[:-1]  # rows that repeat a document are the same place
    onward[many[order[~one]]] = -1
    many = many[order[one]]
    alone = whole[many] == 0
    tell = np.where(alone, mix(doc[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[many].astype(np.uint64)), whole[many])
    order, kind = _groups(first[many], tell)
    many, alone = many[order], alone[order]
    lead = np.append(True, kind[1:] != kind[:-1])
    copies = np.bincount(kind)[kind]
    digit = np.cumsum(np.append(True, first[many][1:] != first[many][:-1])) - 1
    kinds = np.bincount(digit, lead)[digit]
    members = np.bincount(digit)[digit]
    repeated[many] = (copies > 1) & ~alone
    asked[many] = lead & (kinds > 1)
    ahead = np.append(True, digit[1:] != digit[:-1])
    onward[many] = np.where(ahead, np.where(members == 1, state[many], np.where(kinds > 1, ASKED, WHOLE)), -1)
    return repeated, asked, onward


def _settle_windows(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Of windows met together: which are repeated, and one of each hash to go on."""
    order, same = _groups(hashes, doc, place)
    one = np.ones(len(order), bool)
    one[1:] = same[1:] != same[:-1]
    order = order[one]
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    repeated, onward = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    repeated[order] = np.repeat(size, size) > 1
    onward[order[new]] = True
    return repeated, onward


def repeated_runs(docs: DataFrame, depth: int = DEPTH, step: int = STEP, gram: int = GRAM) -> DataFrame:
    """Maximal runs of bytes to remove: ``doc_id, starts, stops`` (arrays), one row per document that has any.

    Marks and questions travel as packed rows by document: a place times four, plus 0 for a repeated window, 1 for a block that is
    repeated as a whole, 2 for a block whose windows are to be sorted.
    """
    shares = partitions(docs.sparkSession)
    buckets = packed.BUCKETS * shares

    def say(doc: np.ndarray, place: np.ndarray, **what: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = {"window": 0, "block": 1, "question": 2}
        told = np.concatenate([place[which] * 4 + codes[name] for name, which in what.items()])
        doc = np.concatenate([doc[which] for which in what.values()])
        return packed.pack(packed.by_document(doc, shares), doc, told)

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            first, whole, doc, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            repeated, asked, state = _settle_blocks(first, whole, doc, place, np.zeros(len(first), np.int64))
            yield from say(doc, place, block=repeated, question=asked)
            on = state >= 0
            yield from packed.pack(packed.by_hash(first[on], buckets), doc[on], place[on] * 4 + state[on], np.stack([first[on], whole[on]]))

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(chunk.first, len(chunk)).to_numpy()
                first, whole, doc, place = blocks(chunk, depth, step, gram)
                held.append((first, whole, ids[doc], place))
                if sum(len(h[0]) for h in held) >= BUFFER:
                    yield from settle()
        if held:
            yield from settle()

    def meet_blocks(part: pa.Table) -> pa.Table:
        if part["bucket"][0].as_py() < 0:
            return part
        doc, place, (first, whole) = packed.unpack(part, 2)
        place, state = place // 4, place % 4
        repeated, asked, _ = _settle_blocks(first, whole, doc, place, state)
        return packed.table(say(doc, place, block=repeated, question=asked))

    def questions(part: pa.Table) -> pa.Table:
        doc, place, _ = packed.unpack(part)
        pair = np.unique(np.stack([doc, place // 4], axis=1)[place % 4 == 2], axis=0)
        cut = np.flatnonzero(np.append(True, pair[1:, 0] != pair[:-1, 0])) if len(pair) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(cut, len(pair)), pa.int32())
        return pa.table({"doc_id": pair[cut, 0], "places": pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(pair[:, 1]), pa.int64()))})

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            hashes, doc, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            repeated, on = _settle_windows(hashes, doc, place)
            yield from say(doc, place, window=repeated)
            yield from packed.pack(packed.by_hash(hashes[on], buckets), doc[on], place[on], hashes[None, on])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                rows = slice(chunk.first, chunk.first + len(chunk))
                ids, asked = batch.column("doc_id")[rows].to_numpy(), batch.column("places")[rows]
                own = np.repeat(np.arange(len(chunk)), np.diff(asked.offsets.to_numpy()))
                at = asked.flatten().to_numpy()
                low, high = np.maximum(at - step + 1, 0), np.minimum(at, (chunk.stops - chunk.starts)[own] - depth)
                counts = np.maximum(high - low + 1, 0)
                own = np.repeat(own, counts)
                start = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
                flat = np.unique(start + chunk.starts[own])  # blocks of neighbouring anchors overlap
                own = np.searchsorted(chunk.starts, flat, "right") - 1
                held.append((sliced(rolling(BYTE[chunk.data]), flat, flat + depth), ids[own], flat - chunk.starts[own]))
                if sum(len(h[0]) for h in held) >= BUFFER:
                    yield from settle()
        if held:
            yield from settle()

    def meet_windows(part: pa.Table) -> pa.Table:
        if part["bucket"][0].as_py() < 0:
            return part
        doc, place, hashes = packed.unpack(part)
        repeated, _ = _settle_windows(hashes[0], doc, place)
        return packed.table(say(doc, place, window=repeated))

    def merge(part: pa.Table) -> pa.Table:
        doc, place, _ = packed.unpack(part)
        place, what = place // 4, place % 4
        told = what < 2
        doc, place, what = doc[told], place[told], what[told]
        return packed.runs(doc, np.where(what == 1, place - step + 1, place), place + depth)

    rows = texts(docs).where("doc_id IS NOT NULL")
    first = rows.mapInArrow(sort_blocks, packed.SCHEMA).groupBy("bucket").applyInArrow(meet_blocks, packed.SCHEMA)
    first = written(first, "blocks")
    asked = written(first.groupBy("bucket").applyInArrow(questions, "doc_id long, places array<long>"), "questions")
    asked = small(asked, 8 * F.size("places"))
    second = rows.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(sort_windows, packed.SCHEMA)
    second = second.groupBy("bucket").applyInArrow(meet_windows, packed.SCHEMA)
    return first.unionByName(second).groupBy("bucket").applyInArrow(merge, packed.RUNS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            rows = slice(chunk.first, chunk.first + len(chunk))
            data, out, removed, spans = chunk.data.tobytes(), [], [], []
            runs = zip(batch.column("starts")[rows].to_pylist(), batch.column("stops")[rows].to_pylist())
            for begin, end, (starts, stops) in zip(chunk.starts.tolist(), chunk.stops.tolist(), runs):
                starts, stops = starts or [], stops or []
                out.append(b"".join([data[begin + a : begin + b] for a, b in zip([0, *stops], [*starts, end - begin])]))
                removed.append(end - begin - len(out[-1])), spans.append(len(starts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], pa.array(chunk.stops - chunk.starts), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
            )


def remove_repeated_bytes(docs: DataFrame, depth: int = DEPTH, step: int = STEP, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_bytes`` of each row of ``docs``: every byte is removed that lies in a string of
    ``depth`` bytes of one document that also starts at another place, of the same document or of another one; all places are removed.

    docs: ``doc_id`` and ``text``; null texts are empty, and texts are UTF-8 bytes, which a cut may separate. Rows with the same ``doc_id``
    count as one document: what they have in common at the same place isn't repeated, and what one of them loses the others lose.
    Rows without ``doc_id`` take no part and keep all. Further columns are ignored.
    """
    runs = written(repeated_runs(docs, depth, step, gram), "runs")
    runs = small(runs, 16 * F.size("starts"))
    joined = texts(docs).join(runs, "doc_id", "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
