"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic; a cell's weight starts as its number of tokens. Raking scales the weights
of each margin in turn to its target share, until every value is within a stated tolerance of its goal. Each document is then kept
with the probability ``budget * weight / tokens`` of its cell, by a draw that depends on its id and the seed alone; the budget is
the wanted one, or the largest at which no probability exceeds one. All work over documents is one count and one join with the
cells; raking runs over the cells, of which there are as many as combinations of values.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.tables import small, unused, written

#: A margin's target share is its present share to this power, scaled to one: below 1, small values gain.
TEMPERATURE = 0.7
BUDGET, SEED = 0.75, 17
#: Raking ends when no value of a margin is further from its goal than this share of it, and warns if it isn't by then.
TOLERANCE, MOST_ROUNDS = 1e-6, 100
#: Rounds from one look at the margins to the next.
ROUNDS = 4
#: Up to so many cells, a value's sum is taken over a window of one partition; beyond, sums are aggregated by value and joined.
FEW = 100_000
MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def draw(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 of 52 bits, the same for a key wherever it lies."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def _goals(cells: DataFrame, total: int, temperature: float, targets: DataFrame | None) -> dict[str, DataFrame]:
    """For each margin its values and their goals of tokens: smoothed shares, or those of the weights in ``targets``."""
    powers = [
        cells.groupBy(F.col(m).cast("string").alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("power")).withColumn("margin", F.lit(m))
        for m in MARGINS
    ]
    rows = written(powers[0].unionByName(powers[1]).unionByName(powers[2]), "powers")
    if targets is not None:
        given = targets.select("margin", F.col("value").cast("string").alias("value"), F.col("weight").cast("double").alias("given"))
        asked = [r.margin for r in given.where(F.col("margin").isin(*MARGINS)).select("margin").distinct().collect()]
        told = rows.join(given, ["margin", "value"], "left").select("margin", "value", F.when(F.col("margin").isin(asked), F.col("given")).otherwise(F.col("power")).alias("power"))
        rows = written(told, "powers")
        bad = rows.groupBy("margin", "value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.isnan("power") & (F.col("power") >= 0), 1)).alias("good")).where("n > 1 OR good < 1")
        if not bad.isEmpty():
            raise ValueError("targets need one weight, not below zero, for each value of their margins")
    scales = {r.margin: r.scale for r in rows.groupBy("margin").agg(F.sum("power").alias("scale")).collect()}
    if not all(scales.values()):
        raise ValueError("targets leave nothing of a margin")
    goal = lambda m: (F.lit(float(total)) * F.col("power") / F.lit(scales[m])).alias(f"goal_{m}")
    return {m: rows.where(F.col("margin") == m).select(F.col("value").alias(f"value_{m}"), goal(m)) for m in MARGINS}


def _scaled(cells: DataFrame, m: str, few: bool) -> DataFrame:
    """Weights scaled to the goals of margin ``m``, and ``off``: the most by which a value of a cell missed its goal in this round."""
    if few:
        out = cells.withColumn("sum", F.sum("weight").over(W.partitionBy(m)))
    else:
        out = cells.join(small(written(cells.groupBy(m).agg(F.sum("weight").alias("sum")), "sums")), m)
    factor, goal = F.when(F.col("sum") > 0, F.col(f"goal_{m}") / F.col("sum")).otherwise(0.0), F.col(f"goal_{m}")
    missed = F.when(goal > 0, F.abs(factor - 1)).otherwise(0.0)
    return out.withColumns({"weight": F.col("weight") * factor, "off": F.greatest("off", missed)}).drop("sum")


def rake(
    cells: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, targets: DataFrame | None = None, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS
) -> tuple[DataFrame, float]:
    """``cells`` (margins, ``tokens`` above zero) with ``probability``, and the budget that they have: the wanted one, or the largest
    at which no probability exceeds one.

    Every value of a margin gets its goal to within ``tolerance`` of it. Margins that exclude each other (a source of one language
    only, say) may have no such weights: after ``most`` rounds a warning says by how much they are missed. Up to ``FEW`` cells one
    task holds those of a value; beyond, sums are aggregated by value, and no task holds all cells, or all those of a value.
    """
    out = written(cells.select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("weight")), "cells")
    n, total = out.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not total:
        return out.select(*MARGINS, F.lit(budget).alias("probability")), budget
    for m, goals in _goals(out, total, temperature, targets).items():
        out = out.join(small(goals), F.col(m).cast("string") == F.col(f"value_{m}")).drop(f"value_{m}")
    few, made, missed = n <= FEW, 0, float("inf")
    out = written(out.coalesce(1) if few else out, "weights")
    while made < most and missed > tolerance:
        out = out.coalesce(1) if few else out
        for _ in range(min(ROUNDS, most - made)):
            out, made = out.withColumn("off", F.lit(0.0)), made + 1
            for m in MARGINS:
                out = _scaled(out, m, few)
            out = out if few else written(out, "weights")
        out = written(out, "weights") if few else out
        missed = out.agg(F.max("off")).first()[0]
    if missed > tolerance:
        warnings.warn(f"after {made} rounds margins are missed by up to {missed:.2g} of their goals", stacklevel=2)
    budget = min(budget, out.where("weight > 0").agg(F.min(F.col("tokens") / F.col("weight"))).first()[0])
    return out.select(*MARGINS, F.round(F.least(F.lit(1.0), F.lit(budget) * F.col("weight") / F.col("tokens")), 9).alias("probability")), budget


def mix_documents(docs: DataFrame, topics: DataFrame | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED, targets: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, sampled`` for each row of ``docs``.

    docs: ``doc_id, text, source, lang``; tokens are words, null texts have none; null sources and languages are values of their own,
    ``""``. topics: ``doc_id, topic`` (of several the smallest; ``-1`` where there is none). Cells without tokens have the budget as
    probability. Repeated rows share their draw, and rows without ``doc_id`` are drawn as one. Further columns are ignored.

    targets: ``margin`` (one of ``MARGINS``), ``value`` and ``weight``, for the margins whose shares aren't the smoothed ones; every
    value in ``docs`` of such a margin needs a weight.
    """
    key = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(
        key, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    if topics is None:
        rows = rows.withColumn("topic", F.lit(-1).cast("long"))
    else:
        named = topics.where("doc_id IS NOT NULL").groupBy(key).agg(F.min(F.col("topic").cast("long")).alias("topic"))
        rows = rows.join(named, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1).cast("long")))
    rows = written(rows, "counted")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked, budget = rake(cells, budget, temperature, targets)
    rates = small(written(raked, "rates"))
    out = rows.join(rates, list(MARGINS), "left").withColumn("probability", F.coalesce("probability", F.lit(budget)))
    return out.select("doc_id", *MARGINS, "n_tokens", "probability", (_draw_of("doc_id", seed) < F.col("probability")).alias("sampled"))


def _draw_of(key: str, seed: int) -> Column:
    return draw(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)


def sampled_documents(docs: DataFrame, topics: DataFrame | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED, targets: DataFrame | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, by ``mix_documents``. What isn't sampled leaves by its id, source and language."""
    mixed = written(mix_documents(docs, topics, budget, temperature, seed, targets), "mixed").where("NOT sampled")
    names = {c: unused(docs, f"_{c}") for c in ("doc_id", "source", "lang")}
    gone = small(written(mixed.select(*(F.col(c).alias(name) for c, name in names.items())).distinct(), "unsampled"), *(F.length(names[c]) for c in ("source", "lang")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"]))
    for c in ("source", "lang"):
        same = same & (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(names[c]))
    return docs.join(gone, same, "left_anti")


def mixing_sql(budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The same over ``documents`` and ``embeddings`` in SQL."""
    names = ", ".join(MARGINS)
    powers = ", ".join(f"pow((sum(tokens) OVER (PARTITION BY {m}))::DOUBLE, {temperature}) AS p_{m}" for m in MARGINS)
    goals = ", ".join(f"(SELECT sum(tokens) FROM cells)::DOUBLE * p_{m} / (SELECT sum(p) FROM (SELECT DISTINCT {m}, p_{m} AS p FROM powers)) AS goal_{m}" for m in MARGINS)
    kept = ", ".join(f"goal_{m}" for m in MARGINS)
    step = f"SELECT *, weight AS w0 FROM raked WHERE round < {MOST_ROUNDS} AND (round % {ROUNDS} > 0 OR off > {TOLERANCE})"
    for k, m in enumerate(MARGINS):
        step = f"SELECT *, w{k} * f{k} AS w{k + 1} FROM (SELECT *, goal_{m} / sum(w{k}) OVER (PARTITION BY {m}) AS f{k} FROM ({step}))"
    return f"""
WITH RECURSIVE topics AS (SELECT vec_id AS doc_id, min(label)::BIGINT AS topic FROM embeddings GROUP BY vec_id),
counted AS (SELECT d.doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(topic, -1)::BIGINT AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN topics t ON d.doc_id = t.doc_id),
cells AS (SELECT {names}, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY ALL HAVING sum(n_tokens) > 0),
powers AS (SELECT *, {powers} FROM cells),
goals AS (SELECT {names}, tokens, {goals} FROM powers),
raked AS (SELECT 0 AS round, {names}, tokens, {kept}, tokens::DOUBLE AS weight, 1.0::DOUBLE AS off FROM goals
  UNION ALL SELECT round + 1, {names}, tokens, {kept}, w3, max(greatest(abs(f0 - 1), abs(f1 - 1), abs(f2 - 1))) OVER () FROM ({step})),
weights AS (SELECT * FROM raked WHERE round = (SELECT max(round) FROM raked)),
budget AS (SELECT least({budget}::DOUBLE, min(tokens / weight)) AS budget FROM weights),
rates AS (SELECT {names}, round(least(1.0, budget * weight / tokens), 9) AS probability FROM weights, budget)
SELECT c.doc_id, c.source, c.lang, c.topic, c.n_tokens, coalesce(probability, budget)::DOUBLE AS probability,
  ('0x' || substr(md5('{seed}:' || c.doc_id), 1, 13))::BIGINT / 16.0::DOUBLE ** 13 < coalesce(probability, budget)::DOUBLE AS sampled
FROM counted c LEFT JOIN rates r ON c.source = r.source AND c.lang = r.lang AND c.topic = r.topic, budget"""
