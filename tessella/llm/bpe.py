"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Texts are split without a regular expression. Every code point has a class; white space and apostrophes get theirs with a look ahead of
one or two places. A class is a function from states to states, and functions are composed by an associative scan: each block of
code points is one composed function, the blocks are combined by doubling, and then every block knows the state it starts in.
State and class together say whether a piece opens at a code point.

Equal pieces of a chunk are merged once: a heap of pairs by rank, kept for later chunks. Ids go back to all places of their piece,
together with the byte at which each token starts, so that decoding places tokens without a running sum over the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.tables import texts
from tessella.llm.words import BYTE, Chunk, chunks, rolling, sliced

KEPT = 1 << 18  # merged pieces that a worker keeps
LONGEST = 64  # bytes of a piece that is kept

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, BREAK, WHITE = range(8)  # SHORT, LONG: apostrophes before one or two letters of a contraction
FIRST = 8  # added to the class of a document's first code point
IDLE = 16  # padding: leaves every state as it is
#: States after a code point: nothing open; in a piece of letters, numbers or others; after a blank that the next piece takes along;
#: in a run of white space; before the last letter, or the last two, of a contraction.
FRESH, LETTERS, NUMBERS, OTHERS, JOINED, RUN, ONE, TWO = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state that follows, and whether a piece opens, by class and state."""
    then, opens = np.zeros((17, 8), np.uint8), np.zeros((17, 8), bool)
    then[[LETTER, NUMBER, OTHER]] = np.array([[LETTERS], [NUMBERS], [OTHERS]])
    then[LETTER, [ONE, TWO]] = FRESH, ONE
    then[[SHORT, LONG]] = np.array([[ONE], [TWO]])
    then[[SHORT, LONG], OTHERS] = then[[SHORT, LONG], JOINED] = OTHERS
    then[[BLANK, BREAK, WHITE]] = np.array([[JOINED], [FRESH], [RUN]])
    opens[:] = True
    for kind, inside in ((LETTER, [LETTERS, JOINED, ONE, TWO]), (NUMBER, [NUMBERS, JOINED]), (OTHER, [OTHERS, JOINED]), (SHORT, [OTHERS, JOINED]), (LONG, [OTHERS, JOINED]), (WHITE, [RUN])):
        opens[kind, inside] = False
    then[FIRST : FIRST + 8] = then[:8, [FRESH]]  # a first code point doesn't depend on what stood before
    opens[FIRST : FIRST + 8] = True
    then[IDLE], opens[IDLE] = np.arange(8), False
    return then, opens


THEN, OPENS = _tables()


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = (ord(every[x]) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind  # a run never crosses the gap of the surrogates: its neighbours aren't of these kinds
    return out


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The class of each code point of documents that start at ``firsts``."""
    out = kinds()[points]
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    ahead = np.zeros(n + 3, points.dtype)
    ahead[:n] = points
    white = np.append(out == WHITE, [False] * 3)
    last = white[:n] & ~first[1 : n + 1] & ~white[1 : n + 1]  # white space right before something else
    out[last] = np.where(points[last] == 0x20, BLANK, BREAK)
    at = np.flatnonzero(points == 0x27)
    one, two = ahead[at + 1], ahead[at + 2]
    inside = ~first[at + 1]
    out[at[inside & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    out[at[inside & ~first[at + 2] & pair]] = LONG
    out[firsts] += FIRST
    return out


def scan(kind: np.ndarray) -> np.ndarray:
    """The state before each code point, by composing the functions of all before it."""
    n = len(kind)
    width = max(16, 1 << max(0, n.bit_length() // 2 - 2))
    rows = -(-n // width)
    steps = np.full(rows * width, IDLE, np.intp)
    steps[:n] = kind
    steps = np.ascontiguousarray(steps.reshape(rows, width).T) * 8  # one step of all blocks at a time
    flat = THEN.ravel()
    block = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for step in steps:
        block = flat.take(step[:, None] + block)
    reach = 1
    while reach < rows:  # composed with the blocks before, twice as many each time
        later = np.take_along_axis(block[reach:], block[:-reach].astype(np.intp), axis=1)
        block = np.concatenate([block[:reach], later])
        reach *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = block[:-1, FRESH]
    out = np.empty((width, rows), np.uint8)
    for t, step in enumerate(steps):
        out[t] = state
        state = flat.take(step + state)
    return out.T.ravel()[:n]


def split_pieces(chunk: Chunk) -> np.ndarray:
    """The byte of a chunk at which each piece starts; pieces follow each other without gaps and don't cross documents."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    firsts = np.searchsorted(lead, chunk.starts[chunk.stops > chunk.starts])
    kind = classes(points, firsts)
    return lead[OPENS[kind, scan(kind)]]


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, as many as ``counts[i]``, for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


class Vocabulary:
    """Ranks of a byte-level vocabulary, the merges of pieces, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        words: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            words[rank] = word
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.kept: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: itself if it has a rank, else the pair of lowest rank is joined, the leftmost of equal ones first."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        edges = self._joined(piece) if len(piece) <= LONGEST else self._joined_by_heap(piece)
        return [self.ranks[piece[a:b]] for a, b in zip(edges, edges[1:])]

    def _joined(self, piece: bytes) -> list[int]:
        """Edges of the parts of a short piece: a list of the ranks of neighbours, searched anew for each join."""
        get, none = self.ranks.get, len(self.sizes)
        edges = list(range(len(piece) + 1))
        pairs = [get(piece[a : a + 2], none) for a in edges[:-2]]
        while pairs:
            rank = min(pairs)
            if rank == none:
                break
            i = pairs.index(rank)
            del edges[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[edges[i] : edges[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[edges[i - 1] : edges[i + 1]], none)
        return edges

    def _joined_by_heap(self, piece: bytes) -> list[int]:
        """The same for a piece of any length, in time that grows little faster than it does."""
        get, n = self.ranks.get, len(piece)
        stop, before, heap = list(range(1, n + 1)), list(range(-1, n)), []  # of the part that starts at a byte; 0: none starts there

        def offer(a: int) -> None:
            b = stop[a]
            if b < n and (rank := get(piece[a : stop[b]])) is not None:
                heappush(heap, (rank, a, stop[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, c = heappop(heap)
            b = stop[a]
            if not 0 < b < c or stop[b] != c:
                continue  # one of the two has been joined with something else
            stop[a], stop[b] = c, 0
            if c < n:
                before[c] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        edges = [0]
        while edges[-1] < n:
            edges.append(stop[edges[-1]])
        return edges

    def ids_of(self, piece: bytes) -> list[int]:
        found = self.kept.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(piece) <= LONGEST:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk's documents one after the other, the byte of its document at which each one starts, and ids per document."""
        data, start = chunk.data, split_pieces(chunk)
        size = np.diff(np.append(start, len(data)))
        hashes = sliced(rolling(BYTE[data]), start, start + size)
        _, lead, same = np.unique(hashes, return_index=True, return_inverse=True)
        # Equal hashes are equal bytes almost surely; a piece that differs from the first one of its hash is merged by itself.
        piece = np.repeat(np.arange(len(start)), size)
        differs = size[piece] != size[lead[same]][piece]
        twin = np.minimum(start[lead[same]][piece] + np.arange(len(data)) - start[piece], len(data) - 1)
        differs |= data != data[twin]
        odd = np.unique(piece[differs])
        same[odd] = len(lead) + np.arange(len(odd))
        lead = np.append(lead, odd)
        raw = data.tobytes()
        merged = [self.ids_of(raw[a:b]) for a, b in zip(start[lead].tolist(), (start + size)[lead].tolist())]
        counts = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, int(counts.sum()))
        ids = flat[_ragged((np.cumsum(counts) - counts)[same], counts[same])]
        place = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        per_doc = np.diff(np.append(0, np.searchsorted(place, chunk.stops)))
        return ids, place - np.repeat(chunk.starts, per_doc), per_doc

    def decode(self, ids: np.ndarray, place: np.ndarray, per_doc: np.ndarray) -> list[bytes]:
        """Bytes of documents from their ids and the byte at which each of them starts."""
        if len(ids) and not ((ids >= 0) & (ids < len(self.sizes))).all() or (self.sizes[ids] == 0).any():
            raise ValueError("an id that the vocabulary doesn't have")
        size = self.sizes[ids]
        last = np.cumsum(per_doc) - 1
        length = np.where(per_doc > 0, (place + size)[np.maximum(last, 0)], 0) if len(ids) else np.zeros(len(per_doc), np.int64)
        base = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.uint8)
        out[_ragged(place + np.repeat(base, per_doc), size)] = self.data[_ragged(self.first[ids], size)]
        raw = out.tobytes()
        return [raw[a : a + n] for a, n in zip(base.tolist(), length.tolist())]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def readable(column: pa.Array) -> pa.Array:
    """``column`` with the replacement character for bytes that aren't UTF-8."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()], pa.string())


ENCODED = "doc_id long, ids array<int>, offsets array<int>"


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, offsets``, one row for each row of ``docs``: the ids of its text, and the byte at which each of them starts.

    docs: ``doc_id`` and ``text``; null texts are empty and have no ids, bytes that aren't UTF-8 count as U+FFFD. Texts are encoded whole,
    without special tokens. Repeated rows and rows without ``doc_id`` are encoded like all others; an empty table gives an empty one.
    Further columns of any name are ignored. path: a rank file that all workers find there.
    """
    path = path or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for chunk in chunks(readable(batch.column("text"))):
                ids, place, per_doc = words.encode(chunk)
                cut = pa.array(np.append(0, np.cumsum(per_doc)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (ids, place)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), *lists], ["doc_id", "ids", "offsets"])

    return texts(docs).mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, packed_ids, decoded``, one row for each row of ``encoded``: its ids as little-endian unsigned 32-bit integers,
    as token shards hold them, and the bytes they stand for.

    encoded: ``doc_id, ids, offsets`` as ``encode_documents`` gives them; null ids are none. An id that the vocabulary doesn't have fails.
    Repeated rows are decoded each; an empty table gives an empty one. Further columns of any name are ignored.
    """
    path = path or default_vocabulary()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids, place = batch.column("ids"), batch.column("offsets")
            per_doc = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
            flat = ids.flatten().to_numpy().astype(np.int64)
            out = words.decode(flat, place.flatten().to_numpy().astype(np.int64), per_doc)
            packed = flat.astype("<u4").tobytes()
            ends = (4 * np.cumsum(per_doc)).tolist()
            shards = [packed[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(per_doc), pa.array(shards, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "packed_ids", "decoded"])

    chosen = encoded.selectExpr("cast(doc_id AS long) AS doc_id", "cast(ids AS array<int>) AS ids", "cast(offsets AS array<int>) AS offsets")
    return chosen.mapInArrow(decode, "doc_id long, n_tokens long, packed_ids binary, decoded binary")
