"""Packing of tokenised documents into training sequences of balanced attention cost.

Attention over a piece of n tokens costs ``LINEAR * n + QUADRATIC * n ** 2``; a sequence costs the sum of its pieces. A document
first gives its full pieces, each a sequence by itself. The rest of every document is dealt to groups of about ``GROUP`` tokens; a
group opens just as many sequences as its tokens need, and assigns its pieces in descending order to the cheapest sequence with
room for them. A piece that fits nowhere is cut: the cheapest sequence with any room takes what it can. So a group leaves less
than one sequence of padding, and only the rests, fewer than a sequence's tokens per document, are shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import texts, written

CAPACITY, GROUP = 1024, 1 << 20
LINEAR, QUADRATIC = 1.0, 1 / 512
END = 0  # the id that ends every document

_DOUBLE_SPACE = re.compile(r"\s\s")
#: How the byte-level vocabulary splits text before merging, without and with runs of white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPLIT_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the library of that file's format gives them without special tokens added.

    The merging is done by a faster library from the same file. White space in runs needs a look-ahead in the splitting pattern;
    texts without such runs are split by the pattern without it, which gives the same pieces in half the time.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.plain = tiktoken.Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.full = tiktoken.Encoding("full", pat_str=_SPLIT_RUNS, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        encoding = self.full if _DOUBLE_SPACE.search(text) else self.plain
        allowed = {s for s in self.special if s in text}
        return encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Full pieces and the rest of each document; the ids of full pieces are left out unless asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), END).astype(np.uint32)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    whole = len(piece) == capacity
                    out.append((doc, start, len(piece), crc(piece) if whole else None, len(ids), None if whole and not keep_ids else piece.astype("<u4").tobytes()))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return texts(docs).mapInArrow(cut, _PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, first token, tokens, sequence, place) for pieces whose lengths descend."""
    sequences = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(sequences, capacity, np.int64), np.zeros(sequences)
    out = []
    for piece, length in enumerate(lengths.tolist()):
        done = 0
        while done < length:
            rest = length - done
            fits = room >= rest
            if not fits.any():
                fits = room > 0
            best = int(np.where(fits, cost, np.inf).argmin())
            take = min(rest, int(room[best]))
            out.append((piece, done, take, best, capacity - int(room[best])))
            room[best] -= take
            cost[best] += linear * take + quadratic * take * take
            done += take
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    docs: ``doc_id`` and ``text``; null and empty texts have one token, the end. ``ids`` (little-endian 32-bit) is null unless
    asked for. Rows with the same or a null ``doc_id`` are documents of their own. Further columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = written(cut_documents(docs, vocabulary, capacity, keep_ids), "pieces")
    # A row's number in the written table: the same whenever its part is read again.
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    whole, rest = F.col("length") == capacity, F.col("length") < capacity
    tokens = pieces.where(rest).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // GROUP))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        placed = assign(part["length"].to_numpy(), capacity)
        at, first, length, sequence, offset = (np.array(c, np.int64) for c in zip(*placed))
        packed = part["ids"].combine_chunks()
        cut = [np.frombuffer(packed[i].as_buffer(), "<u4")[a : a + n] for i, a, n in zip(at.tolist(), first.tolist(), length.tolist())]
        return pa.table({
            "doc_id": part["doc_id"].take(at), "start": part["start"].to_numpy()[at] + first, "length": length,
            "ids_crc32": pa.array([crc(c) for c in cut], pa.int64()), "doc_tokens": part["doc_tokens"].take(at),
            "sequence_id": 2 * ((key[0].as_py() << 32) + sequence), "offset": offset,
            "ids": pa.array([c.tobytes() if keep_ids else None for c in cut], pa.binary()),
        })

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    group = F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).alias("group")
    dealt = pieces.where(rest).select(group, "doc_id", "start", "length", "doc_tokens", "row", "ids").groupBy("group").applyInArrow(pack, schema)
    full = pieces.where(whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return full.unionByName(dealt)
