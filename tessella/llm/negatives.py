"""Hard negatives by a secondary sort: pair scores sorted within anchors, windows opened by positives and closed by score.

Scores are inner products of integer vectors. Rows and anchors are packed into blocks, and a task forms the products of its blocks of
rows with blocks of anchors, keeping for each anchor, or for each window of an anchor, only the best few it has met. What tasks
kept is dealt by anchor and sorted within partitions by (anchor, descending score, positives first, id): an iterator then
passes over it once, opens a window at every positive, gives each negative to the windows that still take it, and closes a window
when it is full. Nothing but the open windows of one anchor is held.

Blocks of anchors are broadcast while their measured size is small; beyond that, rows and anchors meet in cells of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.tables import measured, small, written

SCALE = 256
ANCHORS, ROWS = 4096, 1024  # of a block
CELL = 64 << 20  # bytes of rows in a cell of the grid
HELD = 64  # blocks of anchors that a task works on at once
NONE = np.iinfo(np.int64).min
_ANCHORS = ["anchors", "anchor_labels", "anchor_data", "tops", "lows"]


class Best:
    """The ``k`` best entries of each group met so far, by descending score and then ascending id. Entries below ``low`` can't enter."""

    def __init__(self, low: np.ndarray, k: int):
        self.low, self.k = low.astype(np.int64), k
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        full = rank == self.k - 1
        self.low[group[full]] = np.maximum(self.low[group[full]], score[full])
        kept = rank < self.k
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]


def _ahead(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``scores`` its k-th largest allowed value: no lower one is among the k best."""
    if scores.shape[1] <= k:
        return np.full(len(scores), NONE)
    low = -np.inf if scores.dtype.kind == "f" else NONE
    found = np.partition(np.where(allowed, scores, low), -k, axis=1)[:, -k]
    return np.where(found == low, NONE, np.where(found == low, 0, found).astype(np.int64))


def _scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Inner products: by floating point where all sums are exact there, else by integers."""
    return a.astype(np.float64) @ b.astype(np.float64).T if bound < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Anchors of a block, and the best partners that they have met: of their own label, or of other labels within their windows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, tops: np.ndarray, lows: np.ndarray, k: int):
        self.ids, self.labels, self.data = ids, labels, data
        self.windows = len(tops) // max(len(ids), 1)
        self.tops = tops.reshape(len(ids), self.windows)
        self.best = Best(lows.copy() if self.windows else np.full(len(ids), NONE), k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, bound: int) -> None:
        scores, best = _scores(self.data, data, bound), self.best
        start = not len(best.group)
        same = self.labels[:, None] == labels[None, :]
        if not self.windows:
            allowed = same & (self.ids[:, None] != ids[None, :])
            if start:
                best.low = np.maximum(best.low, _ahead(scores, allowed, best.k))
            r, c = np.nonzero(allowed & (scores >= best.low[:, None]))
            best.add(r, scores[r, c].astype(np.int64), ids[c])
            return
        low, found = best.low.reshape(len(self.ids), self.windows), []
        for w in range(self.windows):
            allowed = ~same & (scores <= self.tops[:, w, None]) & (scores >= low[:, w, None])
            if start:
                low[:, w] = np.maximum(low[:, w], _ahead(scores, allowed, best.k))
                allowed &= scores >= low[:, w, None]
            r, c = np.nonzero(allowed)
            found.append((r * self.windows + w, scores[r, c].astype(np.int64), ids[c]))
        best.add(*(np.concatenate(x) for x in zip(*found)))

    def kept(self) -> pa.RecordBatch:
        """``anchor_id, score, vec_id``, each pair once."""
        anchor = self.best.group // max(self.windows, 1)
        pairs = np.unique(np.stack([self.ids[anchor], self.best.score, self.best.ids], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(3)], ["anchor_id", "score", "vec_id"])


def _read(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def once(rows: DataFrame) -> DataFrame:
    """``rows`` with one row for each ``vec_id``: the first one by label and components. Only ids are shuffled where none repeats."""
    ids = written(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated")
    if ids.isEmpty():
        return rows
    first = rows.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    return rows.join(ids, "vec_id", "left_anti").unionByName(first)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its ``positives`` best rows
    of the same label, the best ``negatives`` rows of other labels whose score is at least ``low`` and at most ``high`` per cent of the positive's.

    vectors: ``vec_id, label, embedding``; a component x counts as floor(scale * x). is_anchor: a condition on ``vec_id``. Scores are integer
    inner products; ties go to the smaller ``vec_id``. Rows with a null in ``vec_id``, label, vector or a component, with a component
    that isn't finite, or whose vector hasn't the most frequent length take no part. Rows that repeat a ``vec_id`` count once, as the first
    by label and components. A positive with a negative score has no negatives. An anchor without positives or negatives has no rows, nor has
    an empty table. Components so large that a score might leave 64 bits fail. Further columns of any name are ignored.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(fine)
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    shape = rows.groupBy(F.size("q").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("q", F.abs))).alias("most")).orderBy(F.desc("n"), "size").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    size, most = shape["size"], shape["most"] or 0
    bound = size * most * most
    if bound * max(low, high) >= 1 << 63:
        raise ValueError(f"components up to {most} may give scores beyond 64 bits")
    kind = np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
    rows = once(rows.where(F.size("q") == size))

    def matrix(part: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in getattr(part["q"], "chunks", [part["q"]])]).reshape(-1, size)

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids, labels, data = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (ids, labels, data.astype(kind))], ["ids", "labels", "data"])

    def pack_anchors(part: pa.Table) -> pa.Table:
        found = [w or [] for w in part["tops"].to_pylist()]
        windows = max(map(len, found))
        tops = np.array([w + [-1] * (windows - len(w)) for w in found], np.int64)
        lows = np.array([[-(-low * x // high) for x in w] + [0] * (windows - len(w)) for w in found], np.int64)
        values = [part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part).astype(kind), tops, lows]
        return pa.table([pa.array([part["block"][0].as_py()], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["block", *_ANCHORS])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            for i, number in enumerate(cols["block"].to_pylist()):
                if number not in held:
                    if len(held) >= HELD:
                        yield held.pop(next(iter(held))).kept()
                    ids, labels, data, tops, lows = (_read(cols[c][i], kind if c == "anchor_data" else "<i8") for c in _ANCHORS)
                    held[number] = Block(ids, labels, data.reshape(-1, size), tops, lows, negatives if len(tops) else positives)
                held[number].meet(*(_read(cols[c][i], "<i8") for c in ("ids", "labels")), _read(cols["data"][i], kind).reshape(-1, size), bound)
        for block in held.values():
            yield block.kept()

    packed = written(rows.mapInArrow(pack_rows, "ids binary, labels binary, data binary"), "rows")
    anchors = written(rows.where(is_anchor), "anchors")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")

    def partners(asking: DataFrame) -> DataFrame:
        """``anchor_id, score, vec_id``: what each task has kept of the products of its rows with all anchors."""
        packs = written(asking.groupBy("block").applyInArrow(pack_anchors, "block int, " + ", ".join(f"{c} binary" for c in _ANCHORS)), "packs")
        side = small(packs, *(F.length(c) for c in _ANCHORS))
        cells = 1 if side is not packs else max(1, measured(packed, F.length("data"))[1] // CELL)
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        spread = packed.select("*", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int").alias("cell"), every)
        side = side.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        met = spread.join(side if cells > 1 else F.broadcast(side), ["block", "cell"])
        return met.drop("cell").mapInArrow(meet, "anchor_id long, score long, vec_id long")

    asking = anchors.select(block, "vec_id", "label", "q")
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    own = partners(asking.withColumn("tops", F.lit(None).cast("array<long>")))
    own = written(own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "positives")
    tops = own.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("tops"))
    other = partners(asking.join(tops, "vec_id").select("block", "vec_id", "label", "q", "tops"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, open_ = None, []
        for batch in batches:
            out = []
            for own_id, score, is_negative, vec in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "negative", "vec_id"))):
                if own_id != anchor:
                    anchor, open_ = own_id, []
                if not is_negative:
                    open_.append([score, vec, 0])
                    continue
                for w in open_:
                    if low * w[0] <= high * score <= high * w[0] and w[2] < negatives:
                        w[2] += 1
                        out.append((anchor, w[1], w[2], vec, w[0], score))
                open_ = [w for w in open_ if w[2] < negatives and low * w[0] <= high * score]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    both = own.withColumn("negative", F.lit(False)).unionByName(other.withColumn("negative", F.lit(True)))
    ordered = both.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "negative", "vec_id")
    return ordered.mapInArrow(windows, schema)


def negatives_sql() -> str:
    """The query over ``embeddings`` as SQL."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
