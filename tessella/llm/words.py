"""Words and word windows of whole texts as flat numpy arrays: no loop over words or documents.

Words are the maximal runs without the bytes 20 and 09 to 0D; those are single bytes in UTF-8, so bytes can be split directly.
Hashes are Rabin-Karp values modulo 2**64 taken from prefix sums and then mixed, so that all bits depend on all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20  # bytes of text handled at once, or one document if it is longer


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept and doubled as longer texts come."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows by ``sliced``."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def sliced(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the slices ``[start, stop)`` of what ``rolling`` was given."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


#: A random value for each byte, so that similar bytes don't have similar hashes.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Consecutive texts of a batch: their bytes one after the other, and where each one starts and ends."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a batch of texts into chunks of about ``size`` bytes, whole texts each; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        at = offsets[row : stop + 1]
        yield Chunk(row, data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])
        row = stop


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:stop[i]]`` of its chunk; document ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(chunk: Chunk) -> Words:
    """All words of a chunk; no word crosses documents."""
    space = SPACE[chunk.data]
    filled = chunk.stops > chunk.starts
    before = np.ones(len(space), bool)
    before[1:] = space[:-1]
    before[chunk.starts[filled]] = True
    after = np.ones(len(space), bool)
    after[:-1] = space[1:]
    after[chunk.stops[filled] - 1] = True
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(~space & after) + 1
    first = np.searchsorted(start, np.append(chunk.starts, len(space)))
    return Words(start, stop, first)


def hash_words(chunk: Chunk, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of its A-Z in lower case if asked."""
    data = LOWER[chunk.data] if lower else chunk.data
    return sliced(rolling(BYTE[data]), words.start, words.stop) ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of ``size`` consecutive words of one document: its hash, its first word and its document."""
    counts = np.maximum(words.counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + words.first[:-1][doc]
    return sliced(rolling(hashes), at, at + size), at, doc


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that starts at one of ``at``."""
    step = np.zeros(n + size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step)[:n] > 0


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by document, empty documents included."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
