"""What a chain of filters removes in every order it could have.

A document is described by the set of filters it fails, one bit each, so the corpus shrinks to a count for each part and set before any
order is looked at. The step at which an order removes a set is a min-plus product: the matrix of masks (0 where the set fails the
filter, infinity where it doesn't) times the matrix of positions, the inverse permutations of the orders. Counts are then scattered
to (step, order), weighted by documents, good ones and toxic ones, and redundant removals are read off the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SALTS = 4096  # shares of rows without doc_id, which would else meet in one task

_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, fails``: the SHA-256 of each text, and the filters A to D that it fails, as bits 0 to 3."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    rows = rows.withColumn("words", words)
    n, distinct, points = F.size("words"), F.size(F.array_distinct("words")), F.length("text")
    upper = points - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * points, F.rlike("text", F.lit(SYMBOLS))]
    fails = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fails.cast("int").alias("fails"))


def set_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, n, good, toxic``: documents, good ones and toxic ones by part and set of failed filters; at most 32 rows a part.

    Filter E looks for the smallest ``doc_id`` of each text. Equal rows are counted before texts meet, so that a text of very many
    documents sends a row for each part and label; only its first document passes.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False))).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good"), F.col("toxic").alias("bad"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("good"), flag("bad")).withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = described(docs).withColumn("salt", salt).join(known, ["doc_id", "salt"], "left").fillna(False, ["good", "bad"])
    what = ["digest", "part", "fails", "good", "bad"]
    each = joined.groupBy("doc_id", "salt", *what).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kinds = each.groupBy(*what).agg(F.sum("n").alias("n"), unnamed.alias("unnamed"), first.alias("first"))
    kinds = kinds.withColumn("least", F.min("first.doc_id").over(W.partitionBy("digest")))
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    last = 1 << (len(FILTERS) - 1)
    sides = F.array(F.struct(F.col("fails"), passing.alias("n")), F.struct((F.col("fails") + last).alias("fails"), (F.col("n") - passing).alias("n")))
    flat = kinds.select("part", "good", "bad", F.explode(sides).alias("side")).select("part", "good", "bad", "side.fails", "side.n").where("n > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return flat.groupBy("part", "fails").agg(F.sum("n").alias("n"), only("good").alias("good"), only("bad").alias("toxic"))


def removal_steps(orders: np.ndarray, filters: int) -> np.ndarray:
    """The step, from 1, at which each order (rows of filter numbers) removes each set of failed filters; one more than there are steps
    where it is kept. Sets x orders."""
    masks = np.where((np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1, 0, filters + 1)
    positions = np.argsort(orders, axis=1) + 1  # the inverse permutations: at which step a filter comes
    return np.minimum((masks[:, None, :] + positions[None, :, :]).min(axis=2), filters + 1)


def audited(counts: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley by order and step, from the counts of all sets (sets x 3)."""
    filters = orders.shape[1]
    steps = removal_steps(orders, filters)
    sets, many = np.arange(1 << filters), len(orders)
    lost = np.zeros((filters + 2, many, 3), np.int64)
    np.add.at(lost, (steps, np.broadcast_to(np.arange(many), steps.shape)), np.broadcast_to(counts[:, None, :], (*steps.shape, 3)))
    lost = lost[1 : filters + 1].transpose(1, 0, 2)  # order, step, weight
    fails = (sets[:, None, None] >> orders[None]) & 1  # set, order, step: of that step's filter
    redundant = (counts[:, 0, None, None] * fails * (steps[:, :, None] < np.arange(1, filters + 1))).sum(axis=0)
    shapley = np.zeros(filters, np.int64)
    np.add.at(shapley, orders, lost[:, :, 0])
    removed = lost[:, :, 0]
    return np.stack([counts[:, 0].sum() - removed.cumsum(axis=1), removed, redundant, counts[1 << orders, 0], lost[:, :, 1], lost[:, :, 2], shapley[orders]], axis=2)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.

    docs: ``doc_id, lang, text``; a null text is empty, a null language is the part of the empty string. Filters: A fewer than 200 words;
    B fewer than half of the words distinct; C more than 3 in 100 code points in A-Z; D any of ``#$%&*|``; E the text of a
    smaller ``doc_id``. labels: ``doc_id, quality, toxic``; several rows of a document count as one that is good, or toxic, if any of them
    says so. A repeated row counts each time it stands, and neither repeat is E's copy of the other; a row without ``doc_id`` has no
    label, never fails E and makes no other row fail it. An empty table gives no rows; further columns of any name are ignored.
    """
    orders = np.array(list(permutations(range(len(FILTERS)))))
    names = np.repeat(["".join(FILTERS[f] for f in o) for o in orders], len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part"), batch.column("sets").to_pylist()):
                counts = np.zeros((SETS, 3), np.int64)
                for s in found:
                    counts[s["fails"]] = s["n"], s["good"], s["toxic"]
                table = audited(counts, orders).reshape(len(names), len(_COUNTS))
                cols = [pa.array([part.as_py()] * len(names), pa.string()), pa.array(names.tolist()), pa.array(steps), *(pa.array(table[:, i]) for i in range(len(_COUNTS)))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *_COUNTS])

    sets = set_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    return sets.mapInArrow(expand, AUDIT)


def audit_sql() -> str:
    """``audit_filters`` of ``documents`` and ``labels`` as SQL, document by document."""
    later = ", ".join(f"list_position(o, '{f}') AS p{f}" for f in FILTERS)
    removal = "least(" + ", ".join(f"CASE WHEN {f} THEN p{f} ELSE 6 END" for f in FILTERS) + ")"
    fails = "CASE f " + " ".join(f"WHEN '{f}' THEN {f}" for f in FILTERS) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < {MIN_WORDS} AS A, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS B,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(text) AS C, regexp_matches(text, '{SYMBOLS}') AS D,
  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E FROM d LEFT JOIN known ON d.doc_id = known.doc_id),
alone AS (SELECT *, A::INT + B::INT + C::INT + D::INT + E::INT AS failed FROM judged),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
placed AS (SELECT array_to_string(o, '') AS filter_order, o, {later} FROM orders),
fate AS (SELECT part, filter_order, o, good, toxic, A, B, C, D, E, failed, {removal} AS gone FROM alone, placed),
steps AS (SELECT part, filter_order, s AS step, o[s] AS f, count(*) FILTER (gone > s) AS kept, count(*) FILTER (gone = s) AS removed,
  count(*) FILTER (gone < s AND {fails.replace('CASE f', 'CASE o[s]')}) AS redundant, count(*) FILTER (failed = 1 AND {fails.replace('CASE f', 'CASE o[s]')}) AS unique_fails,
  count(*) FILTER (gone = s AND good) AS good_lost, count(*) FILTER (gone = s AND toxic) AS toxic_lost FROM fate, range(1, 6) AS r(s) GROUP BY part, filter_order, o, s)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps"""
