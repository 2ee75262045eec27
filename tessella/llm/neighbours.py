"""Approximate nearest neighbours by largest inner product: stable projections, kd-trees and a chi-square stopping test.

A vector gets one more component, so that all have the same length; the nearest vectors of a query are then those of the largest
inner product. All are projected to ``WIDTH`` dimensions by Gaussian (2-stable) directions: the squared projected distance
of two vectors, divided by their squared distance, follows the chi-square distribution of ``WIDTH`` degrees.

The upper levels of the kd-tree are split by a bounded sample of projections and deal all vectors to leaves; a leaf of many rows is
cut into blocks. Within a block the tree goes on down to buckets. A query first searches its own block, then every block that the
stopping test leaves open. A search takes the buckets in the order of their projected distance, verifies their vectors by exact inner
products, and stops as soon as a vector beyond the next bucket would be among the best with a probability below ``1 - STOP``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.tables import written

WIDTH, STOP, SEED = 8, 0.97, 5
BLOCK, BUCKET, QUERIES = 4096, 256, 8192  # rows of a block, of a bucket; queries searched together
SAMPLE, LEAVES = 20_000, 1024  # projections that split the upper tree, and its most leaves


def chi_square(x: float, degrees: int) -> float:
    """Probability that a chi-square of an even number of degrees is at most ``x``."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_limit(p: float, degrees: int) -> float:
    """The value that a chi-square stays below with probability ``p``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Tree:
    """The upper tree: a complete tree of dimensions and cutoffs in level order."""

    axis: np.ndarray
    cutoff: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        inner, every = len(self.axis), np.arange(len(points))
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (points[every, self.axis[node]] > self.cutoff[node])
        return node - inner


def grow(sample: np.ndarray, levels: int) -> Tree:
    """Split each node at the median of its widest dimension."""
    axis, cutoff = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
    parts = {0: sample}
    for node in range(len(axis)):
        part = parts.pop(node)
        if len(part):
            axis[node] = np.argmax(part.max(0) - part.min(0))
            cutoff[node] = np.median(part[:, axis[node]])
        right = part[:, axis[node]] > cutoff[node] if len(part) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return Tree(axis, cutoff)


def buckets(points: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Row numbers of the lowest kd-tree nodes."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = points[rows]
        order = np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        out += np.maximum(0, np.maximum(low[:, d] - p, p - high[:, d])) ** 2
    return out


def search(vectors: np.ndarray, ids: np.ndarray, points: np.ndarray, queries: np.ndarray, own: np.ndarray, places: np.ndarray, bound: np.ndarray, square: float, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the ``k`` best of a block for each query, best first (minus infinity where there are fewer).

    own: the queries' ids, which aren't their own neighbours; places: their projections; bound: a score that ``k`` others are known to
    reach; square: squared length of all vectors after the added component.
    """
    best, who = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    parts = buckets(points)
    low, high = np.stack([points[r].min(0) for r in parts]), np.stack([points[r].max(0) for r in parts])
    reach = box_distance(places, low, high)
    order = np.argsort(reach, axis=1)
    norm = (queries**2).sum(1)
    for step in range(len(parts)):
        next_ = order[:, step]
        least = np.maximum(best[:, -1], bound)
        far = np.maximum(norm + square - 2 * least, 0) * limit  # infinite until k are known
        active = np.flatnonzero(reach[np.arange(len(queries)), next_] <= far)
        if not len(active):
            break
        for b in np.unique(next_[active]):
            rows, at = active[next_[active] == b], parts[b]
            rough = queries[rows] @ vectors[at].T
            hit = (rough >= least[rows, None] - 1e-9) & (own[rows, None] != ids[at])
            better = np.flatnonzero(hit.any(1))
            if not len(better):
                continue
            r, c = np.nonzero(hit[better])
            score = np.full((len(better), len(at)), -np.inf)
            # Summed the same way wherever the pair lies, so that equal vectors have equal scores.
            score[r, c] = (queries[rows[better[r]]] * vectors[at[c]]).sum(1)
            names = np.where(np.isfinite(score), ids[at], np.iinfo(np.int64).max)
            s, w = np.concatenate([best[rows[better]], score], 1), np.concatenate([who[rows[better]], names], 1)
            top = np.lexsort((w, -s), axis=1)[:, :k]
            best[rows[better]], who[rows[better]] = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)
    return best, who


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(v.as_buffer() for v in column)
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _found(own: np.ndarray, best: np.ndarray, who: np.ndarray) -> pa.Table:
    r, c = np.nonzero(np.isfinite(best))
    return pa.table({"query_id": own[r], "vec_id": who[r, c], "score": best[r, c]})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, width: int = WIDTH, stop: float = STOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` vectors found of largest inner product, ties to the smaller ``vec_id``.

    vectors: ``vec_id`` and ``embedding`` (array of numbers); is_query: a condition on ``vec_id``. Vectors that are null or zero, that hold a
    null or a non-finite component or that haven't the most frequent length take no part, nor do rows without ``vec_id``. A query is
    never its own neighbour; rows that repeat a ``vec_id`` are candidates each, and a repeated query is searched once. Further columns
    are ignored.
    """
    spark = vectors.sparkSession
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)  # null or non-finite as soon as one component is
    rows = rows.withColumn("square", square).where("square > 0 AND square < double('Infinity')")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    size, total, top = sizes["size"], sizes["n"], sizes["square"]
    directions = np.random.default_rng(SEED).standard_normal((size + 1, width))
    limit = chi_square_limit(stop, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            extra = np.sqrt(np.maximum(top - (data**2).sum(1), 0))
            points = data @ directions[:-1] + extra[:, None] * directions[-1]
            pack = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m, np.float64)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pack(data), pack(points), pack(data @ directions[:-1])], ["vec_id", "vector", "point", "place"])

    flat = rows.where(F.size("v") == size).select("vec_id", "v")
    flat = written(flat.mapInArrow(project, "vec_id long, vector binary, point binary, place binary"), "projected")
    sample = flat.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("point").toArrow()["point"]
    levels = max(0, min(int(math.log2(LEAVES)), math.ceil(math.log2(max(1, total / BLOCK)))))
    tree = grow(_matrix(sample, width), levels)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(_matrix(batch.column("point"), width))
            home = tree.leaf(_matrix(batch.column("place"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(home)], [*batch.schema.names, "leaf", "home"])

    flat = flat.mapInArrow(locate, "vec_id long, vector binary, point binary, place binary, leaf long, home long")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, points = batch.column("leaf").to_numpy(), _matrix(batch.column("point"), width)
            for one in np.unique(leaf):
                own = points[leaf == one]
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([len(own)]), pa.array([own.min(0).tolist()]), pa.array([own.max(0).tolist()])], ["leaf", "n", "low", "high"])

    sides = [f(F.col(c)[d]).alias(f"{c}{d}") for c, f in (("low", F.min), ("high", F.max)) for d in range(width)]
    shape = flat.select("leaf", "point").mapInArrow(boxes, "leaf long, n long, low array<double>, high array<double>").groupBy("leaf").agg(F.sum("n").alias("n"), *sides)
    shape = shape.orderBy("leaf").collect()  # one row for each leaf of the upper tree
    count = {r.leaf: -(-r.n // BLOCK) for r in shape}
    leaf_of, part_of = (np.array(c, np.int64) for c in zip(*((leaf, p) for leaf, n in count.items() for p in range(n))))
    low, high = (np.array([[r[f"{c}{d}"] for d in range(width)] for r in shape for _ in range(count[r.leaf])]) for c in ("low", "high"))

    queries = flat.where(is_query).dropDuplicates(["vec_id"])
    chunks = max(1, -(-queries.count() // QUERIES))
    parts_of = np.zeros(int(leaf_of.max()) + 1, np.int64)
    np.add.at(parts_of, leaf_of, 1)
    first_of = np.concatenate([[0], np.cumsum(parts_of)[:-1]])

    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, salt = batch.column("leaf").to_numpy(), batch.column("salt").to_numpy()
            block = first_of[leaf] + salt % parts_of[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(c) for c in ("vec_id", "vector", "point"))], ["block", "vec_id", "vector", "point"])

    salt = F.pmod(F.xxhash64("vec_id", F.col("vector")), F.lit(1 << 30))
    data = flat.withColumn("salt", salt).mapInArrow(name_blocks, "block long, vec_id long, vector binary, point binary")
    data = written(data, "blocks")
    data = data.select("block", "vec_id", "vector", "point", F.lit(None).cast("double").alias("bound"))
    spread = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")

    def run(part: pa.Table) -> pa.Table:
        asks = part["bound"].is_valid().to_numpy()
        mine, ask = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
        out = []
        if mine.num_rows and ask.num_rows:
            mine = mine.sort_by("vec_id")
            x, points = _matrix(mine["vector"], size), _matrix(mine["point"], width)
            ids = mine["vec_id"].to_numpy()
            for a in range(0, ask.num_rows, 512):
                some = ask.slice(a, 512)
                own = some["vec_id"].to_numpy()
                out.append(_found(own, *search(x, ids, points, _matrix(some["vector"], size), own, _matrix(some["point"], width), some["bound"].to_numpy(), top, k, limit)))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def home_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, ids = batch.column("home").to_numpy(), batch.column("vec_id").to_numpy()
            home = np.where(home < len(parts_of), home, 0)
            home = np.where(parts_of[home] > 0, home, leaf_of[0])
            block = first_of[home] + ids % parts_of[home]
            cols = [batch.column(c) for c in ("vec_id", "vector", "place", "chunk")]
            yield pa.RecordBatch.from_arrays([pa.array(block), *cols], ["block", "vec_id", "vector", "point", "chunk"])

    asked = queries.select("vec_id", "vector", "place", "home", chunk)
    asked = written(asked.mapInArrow(home_blocks, "block long, vec_id long, vector binary, point binary, chunk int"), "queries")
    found_schema = "query_id long, vec_id long, score double"
    columns = ["block", "vec_id", "vector", "point", "bound", "chunk"]
    start = asked.withColumn("bound", F.lit(float("-inf"))).select(columns)
    homes = written(spread.select(columns).unionByName(start).groupBy("block", "chunk").applyInArrow(run, found_schema), "home")
    kth = homes.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounded = asked.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))

    def other_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, places, bound = _matrix(batch.column("vector"), size), _matrix(batch.column("point"), width), batch.column("bound").to_numpy()
            far = np.maximum((vectors**2).sum(1) + top - 2 * bound, 0) * limit
            open_ = box_distance(places, low, high) <= far[:, None]
            open_[np.arange(len(open_)), batch.column("block").to_numpy()] = False
            row, block = np.nonzero(open_)
            cols = [batch.column(c).take(pa.array(row)) for c in ("vec_id", "vector", "point", "bound", "chunk")]
            yield pa.RecordBatch.from_arrays([pa.array(block), *cols], columns)

    rest = bounded.select("block", "vec_id", "vector", "point", "bound", "chunk").mapInArrow(other_blocks, "block long, vec_id long, vector binary, point binary, bound double, chunk int")
    others = spread.select(columns).unionByName(rest).groupBy("block", "chunk").applyInArrow(run, found_schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = homes.unionByName(others).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
