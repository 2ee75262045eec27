"""Near-duplicate documents by one-permutation MinHash.

1. One pass gives each document the size and a fingerprint of its shingle set and a signature: the hash range is cut into bins,
   each bin keeps its smallest shingle hash, and an empty bin takes the value of a filled one chosen by a hash of its number
   (optimal densification). ``BANDS`` bands of ``ROWS`` bins each become keys.
2. Documents with the same set are one class from here on, its representative the smallest ``doc_id``.
3. A bucket (band key) links its representatives to one of them, the one that shares most buckets with others: a star, not all
   pairs. Each representative is compared, on full sets, with the star centre that it shares most bands with.
4. Representatives of buckets that are not yet within one component are compared beyond the stars, by an exact filter: shingles
   are ordered from rare to frequent; two similar sets share one of their first shingles, and what follows it in both must suffice
   for the similarity. So no similar pair of a bucket stays undetected, and sets that are merely alike meet in few pairs.

A pair of similarity 0.85 shares none of 26 bands of 5 with a probability of 2 in 10 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import components
from tessella.llm.tables import small, texts, unused, written
from tessella.llm.words import Chunk, chunks, hash_words, mix, rolling, sliced, split_words, windows

SHINGLE = 5
BANDS, ROWS = 26, 5
PERCENT = 85


def shingle_sets(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by document and value, their document, and where each document's begin."""
    words = split_words(chunk)
    hashes = hash_words(chunk, words, lower=True)
    value, _, doc = windows(words, hashes, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    whole = sliced(rolling(hashes), words.first[short], words.first[short + 1]) ^ np.uint64(0x5851F42D4C957F2D)
    value, doc = np.concatenate([value, whole]), np.concatenate([doc, short])
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(chunk) < 1 << 16 else np.int64), kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, doc, np.searchsorted(doc, np.arange(len(chunk) + 1))


def fingerprints(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes of each set: equal for equal sets."""
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64, out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(value: np.ndarray, doc: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, documents x bins; zeros for empty sets."""
    at = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = doc * bins + at  # ascending, and values ascend within a cell
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    signature, filled = np.zeros(docs * bins, np.uint64), np.zeros(docs * bins, bool)
    signature[cell[lead]], filled[cell[lead]] = value[lead], True
    some = filled.reshape(docs, bins).any(1)
    row, col = np.nonzero(~filled.reshape(docs, bins) & some[:, None])
    attempt = 1
    while len(row):
        tried = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt * bins)) % np.uint64(bins)).astype(np.int64)
        source = row * bins + tried[col]
        hit = filled[source]
        signature[row[hit] * bins + col[hit]] = signature[source[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return signature.reshape(docs, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each document and band."""
    weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    mixed = (mix(signature) * (weights | np.uint64(1))).reshape(len(signature), bands, rows)
    return mix(mixed.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                value, doc, first = shingle_sets(chunk)
                one, two = fingerprints(value, first)
                keys = band_keys(signatures(value, doc, len(chunk), bands * rows), bands, rows)
                offsets = pa.array(np.arange(len(chunk) + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(np.diff(first)), pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "print_1", "print_2", "bands"],
                )

    return run


def sketch_documents(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, print_1, print_2, bands`` for each row of ``docs``."""
    return texts(docs).mapInArrow(_sketch(bands, rows), "doc_id long, n_shingles long, print_1 long, print_2 long, bands array<long>")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            value, _, first = shingle_sets(chunk)
            one, _ = fingerprints(value, first)
            own = one == batch.column("print_1").slice(chunk.first, len(chunk)).to_numpy()
            sets = pa.array([value[a:b].tobytes() for a, b in zip(first[:-1][own], first[1:][own])], pa.binary())
            ids = batch.column("doc_id").slice(chunk.first, len(chunk)).filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([ids, pa.array(one[own]), sets], ["node", "print_1", "members"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) if len(x) + len(y) < 64 else int(np.isin(x, y, assume_unique=True).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, print_1, members`` (packed hashes): the shingle sets of ``nodes`` (``node, print_1``), written."""
    needed = small(written(nodes.select(F.col("node").alias("doc_id"), "print_1").distinct(), "needed"))
    sets = texts(docs).join(needed, "doc_id").select("doc_id", "print_1", "text").mapInArrow(_full_sets, "node long, print_1 long, members binary")
    # A repeated row of a document would repeat its pairs: each set once for each node.
    return written(sets.groupBy("node", "print_1").agg(F.first("members").alias("members")), "sets")


def confirm(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets are similar enough."""
    pairs = small(pairs)
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")).join(pairs, "a")
    rows = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(_compare(percent), "a long, b long").distinct()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column("members")]
        offsets = pa.array(np.cumsum([0, *map(len, members)]), pa.int32())
        values = pa.array(np.concatenate(members) if members else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("print_1"), pa.ListArray.from_arrays(offsets, values)], ["node", "print_1", "shingles"])


def filtered_pairs(sets: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of ``nodes`` (``node, component``) of different components that may be similar enough; none that is gets lost.

    With shingles ordered from rare to frequent, two similar sets share one within the first ``n - ceil(percent * n / 100) + 1`` of each,
    and the shingles from there on, of the shorter rest, must reach the overlap that the similarity asks for. Shingles of one
    node alone come first and are never joined.
    """
    named = sets.join(nodes, "node").select("node", "print_1", "members", "component")
    rows = named.select("node", "print_1", "members").mapInArrow(_unpack, "node long, print_1 long, shingles array<long>")
    rows = written(rows.select("node", "print_1", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = rows.join(often, "shingle").groupBy("node", "print_1", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("known"))
    alone = F.col("n") - F.size("known")
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - alone
    ranked = ranked.where(first > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("known", 1, first.cast("int"))).alias("at", "token"))
    ranked = ranked.select("node", "n", F.col("token.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    ranked = written(ranked.join(small(nodes), "node"), "prefixes")
    mixed = ranked.groupBy("shingle").agg(F.min("component").alias("main"), F.max("component").alias("last")).where("main < last").drop("last")
    ranked = written(ranked.join(mixed, "shingle"), "mixed")
    x = ranked.where("component <> main").select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"), F.col("component").alias("cx"))
    y = ranked.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), F.col("component").alias("cy"))
    enough = (100 + percent) * F.least("rx", "ry") >= percent * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & (x["cx"] != y["cy"]) & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct five-word shingles (A-Z in lower case).
    Texts of one to four words have one shingle; null, empty and blank texts have none and are linked with nothing. ``component_id``
    is the smallest ``doc_id`` reachable over links; ``kept`` marks the documents that are their own. Rows without ``doc_id`` are
    linked with nothing and kept. Rows of one ``doc_id`` each count by their own text. Further columns are ignored.
    """
    sketch = written(sketch_documents(docs, bands, rows), "sketch")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    kind = ["print_1", "print_2", "n_shingles"]
    classes = some.groupBy(*kind).agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    nodes = written(classes.select(*kind, F.col("first.doc_id").alias("node"), F.col("first.bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(members.join(sizes, "key"), "buckets")  # only buckets of two nodes or more
    common = written(shared.groupBy("node").agg(F.sum("size").alias("common")), "common")
    centres = shared.join(small(common), "node").groupBy("key").agg(F.max(F.struct("common", (-F.col("node")).alias("near"))).alias("centre"))
    stars = shared.join(centres, "key").select("node", (-F.col("centre.near")).alias("centre")).where("node <> centre")
    best = stars.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("bands")).groupBy("node").agg(F.max(F.struct("bands", (-F.col("centre")).alias("near"))).alias("best"))
    pairs = written(best.select((-F.col("best.near")).alias("a"), F.col("node").alias("b")), "pairs")
    sets = full_sets(docs, nodes.join(small(common), "node", "left_semi"))
    links = written(confirm(sets, pairs, percent), "confirmed")
    found = small(written(components(links), "components"))

    labelled = shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("last")).where("main < last")
    open_ = written(labelled.join(mixed, "key").select("node", "component").distinct(), "open")
    more = written(filtered_pairs(sets, open_, percent), "pairs")
    links = links.unionByName(confirm(sets, more, percent))
    found = written(components(links), "components")

    named = nodes.select(*kind, "node").join(small(found), "node", "left").select(*kind, F.coalesce("component", "node").alias("component"))
    out = sketch.drop("bands").join(named, kind, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those documents that belong to the class of a smaller ``doc_id``.

    A ``doc_id`` leaves if none of its rows is kept.
    """
    found, name = written(near_duplicates(docs, percent), "classes"), unused(docs, "_gone")
    gone = found.groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("kept")).where("NOT kept").drop("kept")
    gone = small(written(gone, "copies"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
