"""Rows that hold thousands of entries each: a document, a place in it, and hashes.

Entries are dealt to buckets by hash, or to shares by document; one packed row carries all of a buffer's entries for one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, docs binary, counts binary, places binary, hashes binary"
NAMES = ["bucket", "docs", "counts", "places", "hashes"]
BUCKETS = 2  # buckets for each shuffle partition of the session; there are as many shares as partitions, since every bucket may answer every share


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, all lowest bytes first: small numbers leave runs of zeros, which compress."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _pack(doc: np.ndarray, place: np.ndarray, hashes: np.ndarray | None) -> tuple[bytes, bytes, bytes, bytes | None]:
    """Entries sorted by document and place, with places as steps within a document."""
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    step = np.diff(place, prepend=0)
    step[cut] = place[cut]
    counts = np.diff(np.append(cut, len(doc)))
    return doc[cut].astype("<i8").tobytes(), _planes(counts), _planes(step), None if hashes is None else hashes.astype("<u8").tobytes()


def _unpack(docs: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts, step = _unplanes(counts), _unplanes(places)
    first = np.cumsum(counts) - counts
    total = np.cumsum(step)
    base = np.where(first > 0, total[first - 1], 0) if len(first) else first
    return np.repeat(np.frombuffer(docs, "<i8"), counts), total - np.repeat(base, counts)


def unpack(part: pa.Table, kinds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, places and hashes (kinds x entries) of all rows of a bucket or share."""
    doc, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    hashes = [np.zeros((kinds, 0), np.uint64)]
    for d, c, p, h in zip(*(part[x] for x in NAMES[1:])):
        one, two = _unpack(d.as_buffer(), c.as_buffer(), p.as_buffer())
        doc.append(one), place.append(two)
        if h.is_valid:
            hashes.append(np.frombuffer(h.as_buffer(), "<u8").reshape(kinds, -1))
    return np.concatenate(doc), np.concatenate(place), np.concatenate(hashes, axis=1)


def pack(buckets: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket. hashes: kinds x entries."""
    order = np.lexsort((place, doc))
    order = order[np.argsort(buckets[order], kind="stable")]
    buckets, doc, place = buckets[order], doc[order], place[order]
    hashes = None if hashes is None else hashes[:, order]
    cut = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(buckets)]):
        out.append((int(buckets[a]), *_pack(doc[a:b], place[a:b], None if hashes is None else hashes[:, a:b])))
    if out:
        kinds = [pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], NAMES)


def by_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, from 0."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_document(doc: np.ndarray, shares: int) -> np.ndarray:
    """Share of each document, from -1 down, so that shares and buckets don't mix."""
    return -1 - ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shares


def table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.Table.from_batches(batches, schema=pa.schema(list(zip(NAMES, kinds))))


def runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    """``doc_id, starts, stops``: the union of intervals of each document as maximal runs."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    far = int(stop.max()) + 1 if len(stop) else 1
    shift = np.cumsum(new) * far  # documents one after the other, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + shift) if len(stop) else stop
    apart = new.copy()
    apart[1:] |= start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    of, begin, end = doc[first], start[first], (reach - shift)[last]
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cut, len(of)), pa.int32())
    return pa.table({
        "doc_id": of[cut], "starts": pa.ListArray.from_arrays(offsets, pa.array(begin, pa.int64())), "stops": pa.ListArray.from_arrays(offsets, pa.array(end, pa.int64())),
    })


RUNS = "doc_id long, starts array<long>, stops array<long>"
